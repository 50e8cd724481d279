"""Vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegauge.llm import vectors
from pulsegauge.llm.queries import LLM_QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.standard_normal(6).round(2)], 0) for i in range(0, 400)]
    rows += [(100, [1.0] * 6, 1), (100, [1.0] * 6, 1), (None, [1.0] * 6, 0), (500, None, 0), (501, [1.0, None] + [0.0] * 4, 0)]
    rows += [(600, [float("nan")] + [0.0] * 5, 0), (601, [float("inf")] + [0.0] * 5, 0), (700, [0.0] * 6, 0), (800, [2.0, 1.0], 0), (801, [1.0, 1.0], 0)]
    rows += [(1000 + i, [0.5] * 6, 2) for i in range(60)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, row int")


def brute(rows, divisor, k, transform, zero):
    sound = [(v, np.array(transform(x))) for v, x in rows if v is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and (zero or any(x))]
    out = []
    for i, (q, x) in enumerate(sound):
        if q % divisor == 0:
            near = sorted((-(x @ y), v) for j, (v, y) in enumerate(sound) if j != i and len(y) == len(x))[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(near)]
    return sorted(out)


def test_exact_search_equals_brute_force(odd_vectors):
    got = sorted(tuple(r) for r in vectors.exact_top_k(odd_vectors).collect())
    want = brute([(r[0], r[1]) for r in odd_vectors.collect()], 100, 10, lambda x: np.floor(1024 * np.array(x)), True)
    assert got == [(a, b, c, int(d)) for a, b, c, d in want]


def test_small_blocks_change_nothing(odd_vectors, monkeypatch):
    whole = sorted(tuple(r) for r in vectors.exact_top_k(odd_vectors, divisor=10).collect())
    monkeypatch.setattr(vectors, "CANDIDATES", 90)
    monkeypatch.setattr(vectors, "QUERIES", 15)
    assert sorted(tuple(r) for r in vectors.exact_top_k(odd_vectors, divisor=10).collect()) == whole


def test_neighbours_recall(spark):
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    want = {(a, c) for a, _, c, _ in brute(rows, 20, 20, list, False)}
    got = LLM_QUERIES["op5_neighbours"](spark, SF_DIR).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want) >= 0.9
    known = {v: np.array(x) for v, x in rows}
    assert all(abs(r["score"] - known[r["query_id"]] @ known[r["vec_id"]]) < 1e-12 for r in got)


def test_neighbours_odd_rows(odd_vectors):
    got = vectors.approximate_neighbours(odd_vectors).collect()
    want = brute([(r[0], r[1]) for r in odd_vectors.collect()], 20, 20, list, False)
    assert len(got) == len(want) and not {r["vec_id"] for r in got} & {None, 500, 501, 600, 601, 700}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(a, c) for a, _, c, _ in want}) / len({(a, c) for a, _, c, _ in want}) > 0.9


@pytest.mark.parametrize("search", [vectors.exact_top_k, vectors.approximate_neighbours])
def test_counts_joins_and_projections(odd_vectors, search):
    found = search(odd_vectors)
    n = len(found.collect())
    assert n and found.count() == n == found.select("query_id").count()
    assert found.join(odd_vectors.select("vec_id", "row").dropDuplicates(["vec_id"]), "vec_id").count() == n


def test_empty_tables(odd_vectors):
    assert vectors.exact_top_k(odd_vectors.limit(0)).count() == 0
    assert vectors.approximate_neighbours(odd_vectors.filter("vec_id = 500")).count() == 0


def test_chi_square():
    x = np.array([0.0, 2.0, 8.0, 30.0])
    assert np.allclose(vectors.chi_square_cdf(x, 2), 1 - np.exp(-x / 2))
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert abs(vectors.chi_square_cdf(np.array([7.0]), 8)[0] - (draws <= 7).mean()) < 0.01
