"""Near copies by exact Jaccard similarity of word shingles, found where bands of MinHash signatures collide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegauge.llm.rows import KEY, row_key
from pulsegauge.sources.sinks import stored

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity s meets in some band with chance 1 - (1 - s^DEPTH)^BANDS: 0.99992 at 0.8, 0.9999992 at 0.85.
BANDS, DEPTH = 24, 5
#: Shingles that are hashed at a time.
CHUNK = 512
_KEYS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * DEPTH), np.uint64)
_XOR, _TIMES = _KEYS[0], _KEYS[1] | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit digests of a text's word shingles, A-Z lower-cased; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, found = max(1, len(words) - shingle + 1), np.uint64(0)
    for i in range(min(shingle, len(words))):
        found = _mixed(found ^ codes[i : i + n])
    return np.unique(found)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest digest under each of the hash functions."""
    least = [((found[low : low + CHUNK, None] ^ _XOR) * _TIMES).min(axis=0) for low in range(0, len(found), CHUNK)]
    return np.min(least, axis=0)


def bands(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``band`` (digest of a band's number and values) and ``doc`` of every band of every text that has words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), shingle) for x in batch.column(1)]
            known = [i for i, s in enumerate(sets) if len(s)]
            values = np.array([signature(sets[i]) for i in known], np.uint64).reshape(len(known), BANDS, DEPTH)
            codes = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(known), 1))
            for i in range(DEPTH):
                codes = _mixed(codes ^ values[:, :, i])
            docs = batch.column(0).take(pa.array(np.repeat(known, BANDS), pa.int64()))
            yield pa.record_batch([pa.array(codes.reshape(-1).view(np.int64)), docs], ["band", "doc"])

    return texts.select("doc", "text").mapInArrow(cut, f"band bigint, doc {texts.schema['doc'].dataType.simpleString()}")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc`` of the pairs (``first``, ``doc``) whose texts are that similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, last, known = [], None, None
            for i, (a, b) in enumerate(zip(batch.column(1), batch.column(2))):
                if (first := a.as_py()) != last:
                    last, known = first, shingles(first, shingle)
                if jaccard(known, shingles(b.as_py(), shingle)) >= similarity:
                    chosen.append(i)
            yield pa.record_batch([batch.column(0).take(pa.array(chosen, pa.int64()))], ["doc"])

    own = pairs.join(texts.toDF("doc", "own"), "doc")
    both = own.join(texts.toDF("first", "other"), "first").select("doc", "other", "own")
    return both.mapInArrow(compare, f"doc {texts.schema['doc'].dataType.simpleString()}")


def rare_shingles(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``band`` (a shingle) and ``doc`` of the rarest shingles of every text, as far as other texts have them.

    Two sets of that similarity share one of the rarest n - ceil(similarity * n) + 1 of each. The shingles of a
    passage that very many texts hold are common ones, so it does not bring these texts together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            docs = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64()))
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), docs], ["band", "doc"])

    every = stored(texts.select("doc", "text").mapInArrow(cut, f"band bigint, doc {texts.schema['doc'].dataType.simpleString()}"), "shingles")
    counts = stored(every.groupBy("band").agg(F.count("*").alias("n")), "shingle-counts")
    ordered = every.join(counts, "band").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "band"))).alias("all"))
    size = F.size("all")
    first = F.slice("all", F.lit(1), size - F.ceil(size * similarity - 1e-9).cast("int") + 1)
    return ordered.select("doc", F.explode(first).alias("x")).filter("x.n > 1").select("x.band", "doc")


def drop_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that an earlier one is similar to: of any two that meet in a band and are
    that similar at most one stays, and each that goes is that similar to an earlier one.

    Earlier is by id, null ids last, then by a hash of the text. The earliest of every band's group is compared
    with all others by exact Jaccard similarity. Those it is similar to go; the rest meets again by rare
    shingles, twice with the earliest of a group and then in all pairs of what is left. Texts without words stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), *row_key()).alias("doc")
    texts = docs.select(order, "text").dropDuplicates(["doc"])
    dealt = stored(bands(docs.select(order, "text"), shingle).distinct(), "bands")

    def grouped(members: DataFrame) -> DataFrame:
        # stored, as all groups are, so that joins have plain shuffles on both sides and a large group can be split
        firsts = stored(members.groupBy("band").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select("band", "first"), "firsts")
        return stored(members.join(firsts, "band"), "members")

    def similar(pairs: DataFrame) -> DataFrame:
        return stored(_verified(stored(pairs.distinct(), "pairs"), texts, shingle, similarity).distinct(), "similar")

    def without_firsts(live: DataFrame, found: DataFrame) -> DataFrame:
        return live.filter("doc <> first").select("band", "doc").join(found, "doc", "left_anti")

    live = grouped(dealt)
    texts = stored(texts.join(live.select("doc").distinct(), "doc", "left_semi"), "similar-texts")
    gone = [similar(live.filter("doc <> first").select("first", "doc"))]
    # a group's first has met all of its group; others of the group have not met each other
    left = grouped(without_firsts(live, gone[-1])).select("doc").distinct()
    live = grouped(rare_shingles(texts.join(left, "doc", "left_semi"), shingle, similarity))
    for _ in range(2):
        gone.append(similar(live.filter("doc <> first").select("first", "doc")))
        live = grouped(without_firsts(live, gone[-1]))
    pairs = live.select("band", "doc").join(live.select("band", F.col("doc").alias("first")), "band").filter("first < doc")
    gone.append(similar(pairs.select("first", "doc")))
    every = gone[0].union(gone[1]).union(gone[2]).union(gone[3])
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    return rows.join(every.select(*(F.col("doc")[k].alias(k) for k in KEY)).distinct(), list(KEY), "left_anti").select("row.*")
