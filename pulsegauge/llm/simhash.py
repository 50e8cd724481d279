"""SimHash near-duplicates: fingerprints of word shingles, linked by meeting in the middle of the radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.llm.rows import KEY, keep_rows, row_key
from pulsegauge.sources.sinks import stored

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text: bit set if set in over half the shingles' XXH64 (seed 42)."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    counts = np.zeros(64, np.int64)
    for low in range(0, len(shingles), CHUNK):
        digests = b"".join(map(xxhash.xxh64_digest, shingles[low : low + CHUNK], repeat(42)))
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``doc_id``, the row key and ``fp`` (the fingerprint as a signed bigint) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(3)], np.uint64)
            yield pa.record_batch([*batch.columns[:3], pa.array(prints.view(np.int64))], ["doc_id", *KEY, "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(text=text), F.col(text).alias("text"))
    return rows.mapInArrow(compute, f"doc_id bigint, {KEY[0]} bigint, {KEY[1]} bigint, fp bigint")


def _ball(radius: int) -> list[int]:
    """Bit patterns of at most ``radius`` of 64 bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct ``fp`` within ``radius`` differing bits.

    Every fingerprint emits all variants within half the radius. Two fingerprints are within the radius
    exactly if they share a variant, and all that share one are within the radius of each other. So each is
    linked to the smallest that shares the variant: as many edges as members, no pairs. A variant has at
    most as many members as the half ball, whatever the number of copies. Each edge's distance is verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    patterns = F.array(*(F.lit(m).cast("bigint") for m in _ball(radius // 2)))
    # a number of its own: fingerprints are few bytes, which adaptive execution would gather in few tasks before they multiply
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.select("fp").repartition(tasks, "fp")
    variants = spread.select("fp", F.explode(F.transform(patterns, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    members = variants.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n"))
    shared = members.filter("n > 1")
    # most shared variants have two members, known by their ends; only the others go back for the rest
    pairs = shared.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    more = shared.filter("n > 2").select("variant", "low").join(variants, "variant").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.union(more).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of an edge.

    Each round a node takes the smallest label among itself and its neighbours and then that label's own
    label, so labels jump instead of walking; rounds end when no label changes. Every round is written to
    the shared folder, which cuts the lineage.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("node", "near"), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")), "labels")
    while True:
        seen = both.join(labels.toDF("near", "near_root"), "near").groupBy("node").agg(F.min("near_root").alias("near_root"))
        lower = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near_root").alias("root"))
        jump = labels.toDF("root", "further")
        moved = lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("further", "root")).alias("root"))
        moved = stored(moved, "labels")
        if not moved.filter("root <> was").limit(1).count():
            return moved.select("node", "root")
        labels = moved.select("node", "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Component of every row: ``doc_id``, the row key, ``fp``, ``root`` (the component's smallest fingerprint
    of the links) and ``component_id``.

    ``component_id`` is the smallest id among all documents reachable over links, its own included. Null
    and empty texts have fingerprint zero and link like others; repeated rows are one more member each;
    null ids never become a component's id unless all its ids are null; other columns are not read.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(links(prints, radius))
    placed = prints.join(roots.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # stored, so that the join has plain shuffles on both sides and adaptive execution can split a group of copies
    by_print = stored(placed.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return rows.join(by_print, "fp").select("doc_id", *KEY, "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, then of the smallest key."""
    grouped = near_duplicates(docs, shingle, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *KEY))
    return keep_rows(docs, grouped.groupBy("root").agg(first.alias("first")).select("first.*"))
