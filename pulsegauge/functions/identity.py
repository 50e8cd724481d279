"""Stable ids for events and anomaly records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_text(event_us: str | Column) -> Column:
    """Epoch seconds as decimal text: ``1700478600.0``, ``1700478600.25``.

    Made from whole microseconds, so no digit depends on floating-point printing.
    """
    exact = _col(event_us).cast("decimal(20,0)") * F.lit(0.000001).cast("decimal(7,6)")
    trimmed = F.regexp_replace(exact.cast("decimal(27,6)").cast("string"), "0+$", "")
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def number_text(value: str | Column) -> Column:
    """A double as text in positional form between 1e-4 and 1e16, else ``1e-05`` / ``1e+20``.

    Spark prints ``1.0E7`` and ``1.0E-4`` where the id needs ``10000000.0`` and ``0.0001``.
    """
    v = _col(value)
    size = F.abs(v)
    text = v.cast("string")
    positional = F.regexp_replace(v.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1")
    scientific = F.regexp_replace(F.regexp_replace(text, r"(\.0)?E(?=\d)", "e+"), r"(\.0)?E-", "e-")
    scientific = F.regexp_replace(scientific, r"e-(\d)$", "e-0$1")
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), text)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )


def event_id(metric: str | Column, event_us: str | Column, value: str | Column) -> Column:
    """First 16 hex digits of SHA-256 over ``metric:seconds:value``."""
    key = F.concat_ws(":", _col(metric), seconds_text(event_us), number_text(value))
    return F.substring(F.sha2(key, 256), 1, 16)


def anomaly_id(event: str | Column, method: str | Column) -> Column:
    """Record id derived from the event and the method, so that a retry writes the same id."""
    return F.concat(F.lit("anomaly-"), F.substring(F.sha2(F.concat_ws(":", _col(method), _col(event)), 256), 1, 16))
