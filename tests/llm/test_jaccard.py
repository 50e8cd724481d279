"""The similarity join against comparing every two sets."""

from __future__ import annotations

import re

import numpy as np
import pytest

from pulsegauge.llm import jaccard
from pulsegauge.llm.queries import LLM_QUERIES
from tests.llm.conftest import DOCS, SF_DIR

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows, percent=90):
    sets = [brute_set(text) for _, text in rows]
    known = sorted({s for s in sets if s}, key=sorted)
    root = list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(known):
        for j in range(i):
            if 100 * len(a & known[j]) >= percent * len(a | known[j]):
                root[find(i)] = find(j)
    at = {s: find(i) for i, s in enumerate(known)}
    low = {}
    for (doc, _), s in zip(rows, sets):
        if s and doc is not None:
            low[at[s]] = min(doc, low.get(at[s], doc))
    return sorted(((doc, len(s), low.get(at[s]) if s else doc) for (doc, _), s in zip(rows, sets)), key=str)


def found(df, percent=90):
    return sorted((tuple(r) for r in jaccard.similar_sets(df, percent=percent).collect()), key=str)


def near_copies(seed, copies, longest):
    """Edited copies of a few texts at similarities around the limit, and texts that share a passage or nothing."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(1 << 40))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (1, 2, 3, 12, 40, longest, longest + 30):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            copy = list(base)
            for at in rng.integers(0, size, rng.integers(0, max(1, size // 25) + 1)):
                copy[at] = word()
            texts.append(" ".join(copy[: size - int(rng.integers(0, 1 + size // 20))]))
        texts.append(" ".join(passage + base[: size // 2]))
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize(("stars", "members"), [(2, 512), (1, 2)])
def test_near_copies_equal_brute_force(spark, stars, members, monkeypatch):
    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "PARTNERS", 4)
    monkeypatch.setattr(jaccard, "SENT", 1_000_000 if stars == 2 else 0)
    rows = list(enumerate(near_copies(stars, 25, 150)))
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == want
    assert len({r[2] for r in want}) < len(want) - 20


def test_exact_limit(spark):
    """Intersections of exactly nine tenths link, one shingle less does not."""
    base = [f"a{i}" for i in range(21)]
    rows = [(5, " ".join(base)), (3, " ".join(base[:-1] + ["z"])), (2, " ".join(base[:-2] + ["y", "x"])), (9, " ".join(base[1:-1])), (8, " ".join(base[2:]))]
    for percent in (80, 81, 89, 90, 100):
        assert found(spark.createDataFrame(rows, "doc_id bigint, text string"), percent) == brute(rows, percent)


def test_query_equals_brute_force(spark, docs):
    got = LLM_QUERIES["op13_jaccard"](spark, SF_DIR)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs):
    assert found(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert jaccard.similar_sets(no_docs).count() == 0
    with pytest.raises(ValueError):
        jaccard.similar_sets(no_docs, percent=0)


@pytest.mark.parametrize("size", [1, 5, 64, 65, 300, 5000])
def test_sketches_never_differ_in_more_bits_than_sets_and_tell_large_sets_apart(size):
    rng = np.random.default_rng(size)
    for other in (size, size + size // 9, 2 * size):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        for shared in (0, size // 2, size - size // 30, size):
            b = np.unique(np.concatenate((a[:shared], rng.integers(0, 1 << 63, other - shared).astype(np.uint64))))
            apart = jaccard.bits_apart(jaccard.parities(a), jaccard.parities(b))
            assert apart == jaccard.bits_apart(jaccard.parities(b), jaccard.parities(a)) <= len(np.setxor1d(a, b))
            if size >= 300 and shared <= size // 2:  # the most that linked sets of these sizes differ in
                assert apart > len(a) + len(b) - 2 * np.ceil((len(a) + len(b)) * 90 / 190)


def test_lists_of_the_same_members_are_kept_once(spark):
    rows = [(t, c, 100, t + c, c) for t in range(5) for c in range(70)] + [(9, c, 100, 40, c) for c in range(69)] + [(7, c, 100, 3, 1) for c in range(4)]
    live = jaccard._lists(spark.createDataFrame(rows, "token bigint, cid bigint, n bigint, pos bigint, label bigint")).collect()
    assert sorted((r.token, r.cid, r.pos) for r in live) == sorted((t, c, p) for t, c, _, p, _ in rows if t in (0, 9))
    for token in (0, 9):
        (pivots,) = {tuple(p.cid for p in r.pivots) for r in live if r.token == token}
        assert 1 < len(set(pivots)) == len(pivots) <= jaccard.PIVOTS and 0 in pivots


def test_few_pivots_leave_the_rest_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STARS", 1)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rows = list(enumerate(near_copies(7, 25, 150)))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
