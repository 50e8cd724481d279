"""Text projections for alerts, mail details and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegauge.functions.timestamps import micros_to_iso


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimals(value: str | Column, places: int) -> Column:
    """Fixed number of decimals, rounded from the exact binary value and without group separators."""
    return F.replace(F.format_number(_col(value), places), F.lit(","), F.lit(""))


def two_decimals(value: str | Column, missing: str = "0.00") -> Column:
    return F.coalesce(decimals(value, 2), F.lit(missing))


def display_number(value: str | Column) -> Column:
    """Two decimals for a screen, ``N/A`` when there is no number."""
    return two_decimals(value, missing="N/A")


def display_name(metric: str | Column) -> Column:
    return F.when(_col(metric).isNull() | (_col(metric) == ""), F.lit("Unknown")).otherwise(_col(metric))


def alert_subject(metric: str | Column = "metric") -> Column:
    return F.concat(F.lit("Anomaly Alert: "), F.coalesce(_col(metric), F.lit("Unknown")))


# The labels of alert subjects and bodies are those readers of the alerts know.
def alert_body() -> Column:
    """Plain-text message body of an anomaly record; missing numbers show as 0.00."""
    line = lambda label, text: F.concat(F.lit(f"{label}: "), text)
    return F.concat_ws(
        "\n",
        F.lit("Anomaly Detected!"),
        F.lit(""),
        line("Metric", F.coalesce("metric", F.lit("Unknown"))),
        line("Value", two_decimals("value")),
        line("Mean", two_decimals("mean")),
        line("Std Dev", two_decimals("stddev")),
        line("Z-Score", two_decimals("z_score")),
        line("Threshold", two_decimals("threshold")),
        F.lit(""),
        line("Detection Method", F.coalesce("detection_method", F.lit("unknown"))),
        line("Timestamp", micros_to_iso("event_us")),
        line("Detected At", micros_to_iso(F.unix_micros("detected_at"))),
    )


def deviation() -> Column:
    return F.abs(F.col("value") - F.col("mean"))


def deviation_label() -> Column:
    """Distance from the mean with its size in standard deviations, as ``12.34 (3.1σ)``."""
    return F.concat(decimals(deviation(), 2), F.lit(" ("), decimals(F.abs("z_score"), 1), F.lit("σ)"))


def event_time_label(event_us: str | Column = "event_us") -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC."""
    return F.replace(F.substring(micros_to_iso(event_us), 1, 19), F.lit("T"), F.lit(" "))


def recipients(addresses: str | Column) -> Column:
    """Comma list to array, trimmed, empty entries dropped."""
    parts = F.transform(F.split(_col(addresses), ","), lambda a: F.trim(a))
    return F.filter(parts, lambda a: a != "")
