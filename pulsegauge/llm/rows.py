"""Picking rows of a table by decisions made on a narrow copy of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.sources.sinks import stored

KEY = ("__row_id", "__row_text")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns, never null, that tell documents apart; only rows equal in id and text share them."""
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)).alias(KEY[0]),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias(KEY[1]),
    ]


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is in ``chosen``; of several rows with one key, one.

    The whole row travels as one struct, so its columns can have any names.
    """
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    kept = rows.join(chosen.select(*KEY).distinct(), list(KEY), "left_semi")
    one = Window.partitionBy(*KEY).orderBy(*KEY)
    return kept.withColumn("__n", F.row_number().over(one)).filter("__n = 1").select("row.*")


def placed(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``tree`` (a number per group, ascending as ``groups`` sort), ``index`` (from 0 in its group by
    ``order``) and ``size`` (rows of the group); nulls sort first, rows equal in all of ``order`` come in any order.

    Rows are dealt out by ranges of groups and order, so a group of any size spreads over many tasks. Each row's place
    is its partition and its number there; counts per (group, partition), a few for each partition, turn places into indices.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    numbers = F.monotonically_increasing_id()
    ordered = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", numbers), name)
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    group, part = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy("part")
    parts = ordered.groupBy(*groups, "part").agg(F.min("place").alias("low"), F.count("*").alias("n"))
    parts = parts.select(
        "part", "low", F.min("low").over(group).alias("tree"), F.sum("n").over(group).alias("size"),
        F.coalesce(F.sum("n").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        *(F.col(g).alias(f"__{i}") for i, g in enumerate(groups)),
    )
    parts = stored(parts, f"{name}-parts")
    # one row per group and partition: a first row's part and place tell its group, null groups included
    same = [F.col(g).eqNullSafe(F.col(f"__{i}")) for i, g in enumerate(groups)]
    met = ordered.join(parts.withColumnRenamed("part", "__part"), [F.col("part") == F.col("__part"), *same])
    return met.select(*rows.columns, "tree", (F.col("before") + F.col("place") - F.col("low")).alias("index"), "size")
