"""Joins of many rows with a summary that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A summary of at most so many rows is sent to all tasks; a larger one is joined by key and salt.
BROADCAST_ROWS = 200_000
SALTS = 32


def join_summary(rows: DataFrame, summary: DataFrame, on: list[str], how: str = "inner", salt: list[str] | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` with a ``summary`` (unique in ``on``) so that no key's rows meet in one task.

    Spark guesses the size of an aggregate from its input and would shuffle both sides on the key. So the
    summary is counted, at most to the limit: within it the rows stay where they are and the summary is
    broadcast; beyond it each key is split by a hash of the ``salt`` columns and the summary repeated per salt.
    """
    if summary.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(summary), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*(salt or rows.columns)), F.lit(SALTS)))
    repeated = summary.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
