"""SimHash, line dedup, mixing, toxicity and language against brute force and held-out accuracy."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegauge.llm import language, lines, minhash, mixing, simhash, toxicity
from pulsegauge.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests import oracle
from tests.llm.conftest import DOCS, SF_DIR

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """doc_id by fingerprint -> smallest id reachable, by comparing every two fingerprints."""
    prints = sorted(set(items.values()))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    smallest = {}
    for doc, p in sorted(items.items(), reverse=True):
        smallest[find(p)] = doc
    return {doc: smallest[find(p)] for doc, p in items.items()}


def test_simhash_equals_brute_force(spark, docs):
    items = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_components(items)
    got = LLM_QUERIES["op2_simhash"](spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in items.items()}
    assert len(got) == len(items) and len(set(want.values())) < len(want)


def test_simhash_links_chains_and_balls(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = [base ^ (3 << (2 * i)) for i in range(20)] + [base ^ (1 << 63), base ^ (7 << 40)]
    for start in rng.integers(0, 1 << 62, 5):
        chain = int(start)
        for _ in range(30):  # every link two bits further: a long path
            chain ^= sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
            prints.append(chain)
    items = dict(enumerate(dict.fromkeys(prints)))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in items.values()], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    groups, by_brute = defaultdict(set), defaultdict(set)
    for d, p in items.items():
        groups[roots.get(signed(p), signed(p))].add(d)
    for d, c in brute_components(items).items():
        by_brute[c].add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_brute.values()))
    with pytest.raises(ValueError):
        simhash.links(frame, 3)


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert by[3, 0] == by[4, 0] == by[7, 0] == by[None, 0] == 3
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2  # two texts without ids, unlike all others
    assert ids.count(1) == 1 and 3 in ids and 4 not in ids and len({5, 6} & set(ids)) == 1
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def brute_jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs):
    """The stage keeps the smallest id of every component of fingerprints, and nothing else goes."""
    want = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()})
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_similar_odd_rows(odd_docs, no_docs):
    kept = minhash.drop_similar(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and {3, 4, 7} <= set(ids) and len({5, 6} & set(ids)) == 1 and 5 in ids
    assert minhash.drop_similar(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_equals_sql(spark, name):
    columns, got = oracle.spark_rows(LLM_QUERIES[name](spark, SF_DIR))
    assert (columns, got) == oracle.sql_rows(oracle.connect(SF_DIR), LLM_ORACLES[name])


def test_line_dedup_odd_rows(odd_docs, no_docs):
    got = lines.dedup_lines(odd_docs, min_words=10).collect()
    assert len(got) == odd_docs.count()
    by = {r["row"]["doc_id"]: r for r in got if r["row"]["doc_id"] is not None}
    assert by[1]["removed"] == [] and by[2]["clean_text"] == "first line\nlast line"
    span = by[2]["removed"][0]
    assert by[2]["row"]["text"][span["start"] : span["end"]].startswith("Alpha  beta")
    assert by[4]["clean_text"] is None and by[3]["clean_text"] == "" and by[5]["removed"] == []
    assert lines.drop_repeated_lines(odd_docs).columns == odd_docs.columns
    assert lines.dedup_lines(no_docs).count() == 0


def test_pasted_passages_are_cut(spark):
    """A passage inside a line of two documents stays in the first; short repeats and all else stay everywhere."""
    passage = "Every " + ". The ".join(" ".join(f"p{i}q{j}" for j in range(9)) for i in range(6)) + "."
    texts = [
        f"One own beginning without an end {passage} and an end.\nReleased under a licence.",
        f"Another line.\nWords before {passage} words behind.\nReleased under a licence.",
        f"{passage}\n\nReleased under a licence. A clean rest.", "Nothing here repeats. Released under a licence.", passage, passage,
    ]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["row"]["doc_id"]: r["clean_text"] for r in lines.dedup_lines(docs).collect()}
    assert got[0] == texts[0] and got[3] == texts[3]
    assert got[1] == "Another line.\nWords before words behind.\nReleased under a licence."
    assert got[2].endswith("A clean rest.") and "p2q1" not in got[2] and got[4] == got[5] == ""
    assert {r["doc_id"] for r in lines.drop_repeated_lines(docs).collect()} == {0, 1, 2, 3}


def test_line_dedup_stage_cuts_runs_inside_sentences(spark):
    """Runs of 51 to 130 words that start and end inside a sentence go to their true ends; all other words stay."""
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, want = [], {}
    for n in range(51, 131, 4):
        first, head, tail = words(300), words(20), words(30)
        at = int(rng.integers(0, 300 - n))
        rows += [(len(rows), " ".join(first)), (len(rows) + 1, " ".join(head + first[at : at + n] + tail))]
        want |= {len(rows) - 2: " ".join(first), len(rows) - 1: " ".join(head + tail)}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    kept = corpus_pipeline.cut_repeated_lines(spark, docs, SF_DIR)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == want


def test_line_dedup_stage_cuts_short_lines(spark, odd_docs, no_docs):
    """A later whole line goes at any length; the same words inside a line stay."""
    texts = ["Read more\nfirst own line", "second own line\n  read  More\n\nits end", "Read more", "we Read more here"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_lines(spark, docs, SF_DIR).collect()}
    assert got == {0: texts[0], 1: "second own line\nits end", 3: texts[3]}
    assert corpus_pipeline.cut_repeated_lines(spark, odd_docs, SF_DIR).columns == odd_docs.columns
    assert corpus_pipeline.cut_repeated_lines(spark, no_docs, SF_DIR).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = total - sum(fixed.values())
        targets = fixed | {s: share * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if targets[s] > 3 * sizes[s]]
        if not over:
            return targets
        fixed |= {s: 3 * sizes[s] for s in over}


def check_mix(docs, got):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    targets = brute_targets(sizes)
    want = sorted((str(r["doc_id"]), len(WORDS.findall(r["text"] or "")), sizes[r["source"]], round(targets[r["source"]], 3)) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 3)) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == sum(int(t + 1e-9) for t in targets.values())


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_mix_meets_targets(request, name):
    docs = request.getfixturevalue(name)
    check_mix(docs, mixing.Mix(docs).taken().collect())


def test_mix_of_uneven_sources(spark):
    sizes = [1, 1, 2, 50, 900, 3, 7, 1, 400, 20_000, 0, 5]
    rows = [(i, " ".join(["w"] * n), None, f"s{i:02d}" if i else None, 0) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, DOCS)
    mix = mixing.Mix(docs, block=16)
    got = mix.taken().collect()
    check_mix(docs, got)
    pieces = mix.pieces.collect()
    slots = defaultdict(int)
    for p in pieces:
        slots[p["slot"]] += p["words"]
    assert max(slots.values()) <= 16 and len({(p["slot"], p["number"]) for p in pieces}) == len(slots)
    again = mixing.Mix(docs.repartition(5), block=16).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_schedule_is_even(spark):
    targets = spark.createDataFrame([(False, "a", 60_000, 0, 5, 50_000.0), (False, "b", 30_000, 1, 2, 30_000.0), (False, "c", 10_000, 2, 1, 20_000.0)], "no_source boolean, name string, source_size bigint, number int, weight int, target double")
    rows = sorted(mixing.schedule(targets, 10).collect(), key=lambda r: r["slot"])
    seen = [0, 0, 0]
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["number"]]
        seen[r["number"]] += 1
        assert all(abs(seen[k] - i * s) <= 6 for k, s in enumerate((0.5, 0.3, 0.2)))
    assert seen == [5000, 3000, 2000]


def test_mix_rows_repeat_whole_rows(odd_docs, no_docs):
    rows = mixing.Mix(odd_docs).rows()
    assert rows.columns == odd_docs.columns and rows.count() > 0
    assert mixing.Mix(no_docs).rows().count() == 0


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = LLM_QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    assert not any(held(e["doc_id"], 5, 0) for r in got for e in r["evidence"])
    pairs = [(toxic[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    hit = sum(y and p for y, p in pairs)
    # a few labels there have no toxic word to go by
    assert hit / sum(y for y, _ in pairs) > 0.85 and hit / max(1, sum(p for _, p in pairs)) > 0.9


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / max(1e-9, np.linalg.norm(w))))
    index = toxicity.BlockMaxIndex(vectors, np.zeros(700), np.arange(700), 40)
    place = {d: i for i, d in enumerate(index.doc_ids.tolist())}
    for t, w in vectors[:60]:
        numbers, cosines = index.nearest(t, w, 7)
        dense = np.zeros(40)
        dense[t] = w
        every = sorted(((-round(float(dense[a] @ b), 12), place[i]) for i, (a, b) in enumerate(vectors) if len(a) and dense[a] @ b > 0))[:7]
        assert [(-s, n) for s, n in every] == list(zip(cosines.round(12).tolist(), numbers.tolist()))


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (3, None, 0), (None, 0, 1), (99, 0, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_toxicity(odd_docs, labels, lambda c: F.lit(True))
    got = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    nothing = toxicity.train_toxicity(no_docs, labels.limit(0), lambda c: F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, nothing).collect()} == {0.0}
    assert toxicity.drop_toxic(odd_docs, nothing).columns == odd_docs.columns
    assert toxicity.score_toxicity(no_docs, nothing).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = LLM_QUERIES["op7_language"](spark, sf).collect()
    assert len(got) == 1000 and all(r["held_out"] == held(r["doc_id"], 4, 2) for r in got)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.95


def test_language_odd_rows(odd_docs, no_docs):
    model = language.train_language_model(odd_docs)
    got = {(r["doc_id"], r["score"] > 0): r["lang_pred"] for r in language.identify_languages(odd_docs, model).collect()}
    assert got[3, False] == got[4, False] == got[7, False] == "und" and got[5, True] == "en"
    nothing = language.train_language_model(no_docs)
    assert {r["lang_pred"] for r in language.identify_languages(odd_docs, nothing).collect()} == {"und"}
    one = language.train_language_model(odd_docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify_languages(odd_docs, one).collect()} == {"en", "und"}


def test_pipeline_stages(spark, docs, odd_docs, no_docs):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns
    result = corpus_pipeline.run(spark, SF_DIR)
    assert result.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(result.columns)
    for given in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, given, SF_DIR).count()
