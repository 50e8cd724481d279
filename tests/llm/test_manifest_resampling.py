"""Merkle manifest and importance resampling against plain Python versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pulsegauge.llm import merkle, resampling
from pulsegauge.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests import oracle
from tests.llm.conftest import DOCS, SF_DIR


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, lower):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    values[4] = _lower(values[4]) if lower and values[4] is not None else values[4]
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(leaves):
    """The root, and of every leaf its (left, right) siblings by level."""
    nodes, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            low = i // 16 * 16
            paths[leaf].append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 16])))
        nodes = [_hash("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = []
    for s in sources:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, False)))
        below.append((own, *_tree([_leaf(r, False) for r in own])))
    root, tops = _tree([b[1] for b in below]) if below else (None, [])
    out = []
    for (own, subroot, paths), top in zip(below, tops):
        for r, path in zip(own, paths):
            path = path + top
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = _leaf(r, forged)
            for left, right in path:
                node = _hash(left + node + right)
            out.append((r["doc_id"], _leaf(r, False), subroot, root, _hash("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def _manifest(spark, docs, path):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in LLM_QUERIES["op11_merkle"](spark, str(path)).collect()), key=str)


def test_manifest_equals_brute_force(spark, docs):
    got = sorted((tuple(r) for r in LLM_QUERIES["op11_merkle"](spark, SF_DIR).collect()), key=str)
    assert got == brute_manifest(docs.collect())
    assert {r[-1] for r in got} == {True, False}


def test_manifest_equals_sql(spark):
    columns, got = oracle.spark_rows(LLM_QUERIES["op11_merkle"](spark, SF_DIR))
    assert (columns, got) == oracle.sql_rows(oracle.connect(SF_DIR), LLM_ORACLES["op11_merkle"])


def test_manifest_of_odd_rows(spark, odd_docs, tmp_path):
    assert _manifest(spark, odd_docs, tmp_path) == brute_manifest(odd_docs.collect())


@pytest.mark.parametrize("n", [0, 1, 16, 17, 273])
def test_manifest_of_run_sizes(spark, n, tmp_path):
    """Full runs, a run of one at two levels, a lone leaf and no rows."""
    docs = spark.createDataFrame([(i, f"Text {i}", "en", "one", i) for i in range(n)], DOCS)
    assert _manifest(spark, docs, tmp_path) == brute_manifest(docs.collect())


def test_two_children_use_the_same_rule(spark, docs):
    assert {r["root"] for r in merkle.manifest(docs, fanout=2).select("root").collect()} != {None}
    with pytest.raises(ValueError):
        merkle.manifest(docs, fanout=1)


RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    words = RUN.findall(_lower(text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    raw, aim = (Counter(bucket(f) for text in texts for f in _features(text)[1]) for texts in ([r["text"] for r in docs], target))
    S, T = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (S + 10_000) / ((raw[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for r in docs:
        words, found = _features(r["text"])
        weight = sum(gain[bucket(f)] for f in found)
        known = "" if r["doc_id"] is None else r["doc_id"]
        h = int(hashlib.sha256(f"42:{known}".encode()).hexdigest()[:8], 16)
        rows.append([r["doc_id"], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(fit):
        r[4] = i + 1 if i < 5 * len(fit) // 100 else None
    return sorted((tuple(r[:4]) + (r[4] or None,) for r in rows), key=str)


def test_resampling_equals_brute_force(spark, docs):
    target = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = LLM_QUERIES["op12_resampling"](spark, SF_DIR)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == brute_draw(docs.collect(), target) and any(r[4] for r in got)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_resampling_of_odd_rows(spark, odd_docs, docs, block, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", block)
    texts = [r["text"] for r in odd_docs.collect()] + ["a\0b", "\0", "ÀÉ-x_y 9z", None]
    items = [list(resampling.features([None if t is None else t.encode() for t in texts]))][0]
    found = Counter((int(d), int(c)) for doc, codes, _ in items for d, c in zip(doc, codes))
    assert found == Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in _features(t)[1])
    if block > 7:
        rows = odd_docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
        target = spark.createDataFrame([("alpha beta gamma",), (None,), ("",)], "text string")
        got = sorted((tuple(r) for r in resampling.resample(rows, target).collect()), key=str)
        assert got == brute_draw(rows.collect(), ["alpha beta gamma"])


def test_resampling_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, none).count() == 0
    assert sorted((tuple(r) for r in resampling.resample(docs, none).collect()), key=str) == brute_draw(docs.collect(), [])
