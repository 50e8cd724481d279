"""Vector search over a table: exact by branch-and-bound on dimension blocks, approximate by projections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.sources.sinks import stored

#: Candidates and queries that meet in one task call.
CANDIDATES = 4096
QUERIES = 1024
#: Dimensions accumulated between two rounds of pruning.
DIMENSIONS = 8


def finite_vector(vector: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, sound), F.lit(False))


def numbered_vectors(table: DataFrame, keep: Column, vec_id: str, vector: str) -> DataFrame:
    """Stored rows ``row`` (unique), ``vec_id``, ``x`` (doubles) of the vectors that take part; a null id does not."""
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite_vector(F.col("x")) & keep)
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, ids and matrix by vector length, ids ascending."""
    table = table.combine_chunks().sort_by([("vec_id", "ascending"), ("row", "ascending")])
    rows, ids = table["row"].to_numpy(), table["vec_id"].to_numpy()
    lists = table["x"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if isinstance(lists, pa.ChunkedArray):
        return {}
    lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    found = {}
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        found[int(size)] = rows[own], ids[own], flat[starts[own, None] + np.arange(size)]
    return found


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple]


def blockwise_search(vectors: DataFrame, divisor: int, k: int, search: Search, score: str) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the best ``k`` other rows of every query row.

    Queries are the rows whose id is divisible by ``divisor``. Candidates and queries are dealt to blocks by
    a hash of the unique row number; each candidate block meets each query block in one call, which
    returns at most ``k`` rows per query, and a window over those ranks them (ties to the smaller id). Vectors
    of different lengths are not compared. Memory holds one block of either kind.
    """
    queries = vectors.filter(F.col("vec_id") % divisor == 0)
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    dealt = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.select("row", "vec_id", "x", dealt(blocks).alias("block")).select("*", every(query_blocks).alias("query_block"))
    # columns of its own: with ids shared by both sides of the cogroup, column pruning would take a side's columns away
    own = [F.col(a).alias(b) for a, b in (("row", "query_row"), ("vec_id", "query_id"), ("x", "query_x"))]
    right = queries.select(*own, dealt(query_blocks).alias("query_block")).select("*", every(blocks).alias("block"))
    names = ["query_row", "query_id", "vec_id", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if score == "bigint" else pa.float64()]

    def meet(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [pa.table([pa.array([], t) for t in types], names)]
        if candidates.num_rows and asked.num_rows:
            known = _matrices(candidates)
            asked = asked.select(["query_row", "query_id", "query_x"]).rename_columns(["row", "vec_id", "x"])
            for size, (rows, ids, x) in _matrices(asked).items():
                if size in known:
                    columns = search(rows, ids, x, *known[size], k)
                    parts.append(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names))
        return pa.concat_tables(parts)

    key = ("block", "query_block")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"query_row bigint, query_id bigint, vec_id bigint, score {score}")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def branch_and_bound(query_rows, query_ids, queries, rows, ids, vectors, k):
    """Exact best ``k`` by inner product of integer vectors, dimension block by dimension block.

    Vectors lie dimension by dimension. Each query takes its own heaviest dimensions first; after each block the
    rest of a candidate's product is at most the product of the two remaining norms. Candidates whose upper
    bound is below the k-th best lower bound leave, and the survivors are compacted. The remainder is a
    whole product of the survivors in 64-bit integers, so scores are exact.
    """
    whole = vectors.astype(np.int64)
    columns = np.ascontiguousarray(vectors.T)  # one line per dimension
    out = [[], [], [], []]
    squares = columns**2
    for row, query_id, q in zip(query_rows, query_ids, queries):
        order = np.argsort(-np.abs(q), kind="stable")
        alive = np.flatnonzero(rows != row)
        partial = np.zeros(len(alive))
        rest = squares.sum(axis=0)[alive]
        for low in range(0, len(order), DIMENSIONS):
            if len(alive) <= 4 * k:
                break
            block = order[low : low + DIMENSIONS]
            lines = columns[block][:, alive]
            partial += q[block] @ lines
            rest = np.maximum(rest - (lines**2).sum(axis=0), 0)
            later = q[order[low + DIMENSIONS :]]
            # a little room for rounding of norms; products are whole numbers far below 2^53
            bound = np.sqrt(rest * (later @ later)) * (1 + 1e-9) + 1e-6
            floor = np.partition(partial - bound, len(alive) - k)[len(alive) - k]
            stay = partial + bound >= floor
            alive, partial, rest = alive[stay], partial[stay], rest[stay]
        scores = whole[alive] @ q.astype(np.int64)
        best = np.lexsort((ids[alive], -scores))[:k]
        out[0] += [row] * len(best)
        out[1] += [query_id] * len(best)
        out[2] += ids[alive][best].tolist()
        out[3] += scores[best].tolist()
    return out


def exact_top_k(table: DataFrame, k: int = 10, divisor: int = 100, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every query row over vectors of floor(``scale`` * x).

    A query is every row whose id is divisible by ``divisor``; its candidates are all other rows, also those
    that share its id (repeated rows are rows of their own). Vectors null or with null or non-finite
    components, and rows without an id, take no part; empty tables give no rows; other columns are not read.
    """
    vectors = numbered_vectors(table, F.lit(True), vec_id, vector)
    scaled = vectors.withColumn("x", F.transform("x", lambda x: F.floor(x * scale).cast("double")))
    return blockwise_search(scaled, divisor, k, branch_and_bound, "bigint")


#: Projected dimensions, points per leaf, and the probability that the stopping test asks for.
PROJECTED = 8
LEAF = 64
CONFIDENCE = 0.7


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """P(chi-square <= x) for an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def kd_leaves(points: np.ndarray) -> list[np.ndarray]:
    """Point numbers by leaf of a kd-tree: halves at the median of the widest dimension."""
    leaves, waiting = [], [np.arange(len(points))]
    while waiting:
        own = waiting.pop()
        spread = np.ptp(points[own], axis=0)
        if len(own) <= LEAF or not spread.max():
            leaves += np.array_split(own, -(-len(own) // LEAF))
            continue
        by = np.argsort(points[own, spread.argmax()], kind="stable")
        waiting += [own[by[: len(own) // 2]], own[by[len(own) // 2 :]]]
    return leaves


def projected_search(query_rows, query_ids, queries, rows, ids, vectors, k, seed=7):
    """Near-best ``k`` by inner product: verify projected neighbours in order until a chi-square test holds.

    Inner products become Euclidean distances by one more coordinate that brings all candidates to one norm. A
    projection on Gaussian directions (a stable law) gives squared distances that are the true ones times a
    chi-square variable. Projected points lie in a kd-tree; each query visits its leaves by the distance
    to their box, verifies all their points, and stops once an unseen point as near as the k-th found
    would, with the asked confidence, have had a projection nearer than the next box.
    """
    norms = np.einsum("ij,ij->i", vectors, vectors)
    top = norms.max()
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(top - norms, 0))])
    directions = np.random.default_rng(seed).standard_normal((lifted.shape[1], PROJECTED))
    points, wanted = lifted @ directions, queries @ directions[:-1]
    query_norms = np.einsum("ij,ij->i", queries, queries)
    leaves = kd_leaves(points)
    lows, highs = (np.array([f(points[own], axis=0) for own in leaves]) for f in (np.min, np.max))
    boxes = np.stack([(np.maximum(np.maximum(low - wanted, wanted - high), 0) ** 2).sum(axis=1) for low, high in zip(lows, highs)], axis=1)
    order = np.argsort(boxes, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    who = np.full((len(queries), k), -1)
    open_ = np.arange(len(queries))
    for turn in range(len(leaves)):
        leaf_of = order[open_, turn]
        if turn:
            worst = np.maximum(query_norms[open_] + top - 2 * best[open_, k - 1], 1e-300)  # squared distance of the k-th
            ratio = np.where(np.isfinite(worst), boxes[open_, leaf_of] / worst, 0)
            going = chi_square_cdf(ratio, PROJECTED) < CONFIDENCE
            open_, leaf_of = open_[going], leaf_of[going]
        if not len(open_):
            break
        by = np.argsort(leaf_of, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(leaf_of[by])) + 1):
            asked, own = open_[some], leaves[leaf_of[some[0]]]
            scores = queries[asked] @ vectors[own].T
            scores[rows[own][None, :] == query_rows[asked][:, None]] = -np.inf
            better = scores.max(axis=1) >= best[asked, -1]
            asked, scores = asked[better], scores[better]
            merged = np.concatenate([best[asked], scores], axis=1)
            names = np.concatenate([who[asked], np.broadcast_to(own, scores.shape)], axis=1)
            # numbers follow ids, so of equal scores the smaller ids stay
            first = np.lexsort((names, -merged), axis=1)[:, :k]
            best[asked], who[asked] = np.take_along_axis(merged, first, 1), np.take_along_axis(names, first, 1)
    real = best > -np.inf
    q, place = np.nonzero(real)
    found = who[q, place]
    exact = np.einsum("ij,ij->i", queries[q], vectors[found])
    return query_rows[q], query_ids[q], ids[found], exact


def approximate_neighbours(table: DataFrame, k: int = 20, divisor: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """About the ``k`` largest inner products of every query row, in double precision.

    Rows and queries as in ``exact_top_k``; zero vectors take no part either. Every row is indexed.
    """
    vectors = numbered_vectors(table, F.exists("x", lambda x: x != 0), vec_id, vector)
    return blockwise_search(vectors, divisor, k, projected_search, "double")
