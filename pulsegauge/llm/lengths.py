"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.llm.tokens import encoder
from pulsegauge.sources.sinks import stored

#: Lengths per cell of the two-level sums.
CELL = 1024


def length_histogram(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Documents per encoded length: ``n_tokens``, ``documents``.

    Each task counts its own documents, so at most one row per task and length is shuffled. Null and
    empty texts have length 0; repeated rows count each time; other columns are not read; an empty table
    gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = encoder(vocabulary), Counter()
        for batch in batches:
            lengths.update(len(ids.encode(x.as_py())) // 4 for x in batch.column(0))
        yield pa.record_batch([pa.array(lengths.keys(), pa.int64()), pa.array(lengths.values(), pa.int64())], ["n_tokens", "documents"])

    partial = docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens bigint, documents bigint")
    return partial.groupBy("n_tokens").agg(F.sum("documents").alias("documents"))


def length_table(histogram: DataFrame) -> DataFrame:
    """Per length L of the histogram, what a context limit of L tokens means for the corpus.

    ``tokens``: in documents of that length; ``documents_from``, ``tokens_from``: suffix sums over
    lengths of L or more; ``truncated_tokens``: what is left if every document is cut to L tokens;
    ``documents_upto``: documents of at most L tokens. Sums run over cells of lengths first and inside
    a cell second, so no task holds the whole histogram.
    """
    histogram = stored(histogram, "lengths")  # read twice below, and texts are encoded once
    rows = histogram.withColumns({"cell": F.floor(F.col("n_tokens") / CELL), "tokens": F.col("n_tokens") * F.col("documents")})
    cells = rows.groupBy("cell").agg(F.sum("documents").alias("cell_documents"), F.sum("tokens").alias("cell_tokens"))
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda name, w: F.coalesce(F.sum(name).over(w), F.lit(0))
    cells = cells.select(
        "cell", total("cell_documents", after).alias("documents_after"), total("cell_tokens", after).alias("tokens_after"),
        total("cell_documents", before).alias("documents_before"), total("cell_tokens", before).alias("tokens_before"),
    )
    from_here = Window.partitionBy("cell").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    up_to = Window.partitionBy("cell").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    below = up_to.rowsBetween(Window.unboundedPreceding, -1)
    suffix = F.sum("documents").over(from_here) + F.col("documents_after")
    return rows.join(cells, "cell").select(
        "n_tokens", "documents", "tokens",
        suffix.alias("documents_from"),
        (F.sum("tokens").over(from_here) + F.col("tokens_after")).alias("tokens_from"),
        (total("tokens", below) + F.col("tokens_before") + F.col("n_tokens") * suffix).alias("truncated_tokens"),
        (F.sum("documents").over(up_to) + F.col("documents_before")).alias("documents_upto"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: ``documents``, ``tokens`` in all, ``kept_tokens`` and ``cut_documents`` at any context limit."""
    return histogram.select(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.col("n_tokens") * F.col("documents")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("documents")), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("documents"))), F.lit(0)).alias("cut_documents"),
    )


def length_quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of documents does not pass: ``share``, ``n_tokens``."""
    wanted = table.select(F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"), "n_tokens", "documents_from", "documents_upto", "documents")
    everything = F.col("documents_upto") + F.col("documents_from") - F.col("documents")
    reached = wanted.filter(F.col("documents_upto") >= F.ceil(F.col("share") * everything))
    return reached.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
