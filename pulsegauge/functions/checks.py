"""Field checks that turn raw text fields into a typed event or a reject reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegauge.functions.timestamps import epoch_in_range

MAX_METRIC_LENGTH = 255
MAX_ABS_VALUE = 1e308

# Reject reasons.
INVALID_JSON = "invalid_json"
NOT_AN_OBJECT = "not_an_object"
MISSING_FIELD = "missing_field"
METRIC_TYPE = "metric_type"
METRIC_LENGTH = "metric_length"
TIMESTAMP_TYPE = "timestamp_type"
TIMESTAMP_FORMAT = "timestamp_format"
TIMESTAMP_RANGE = "timestamp_range"
VALUE_TYPE = "value_type"
VALUE_NOT_FINITE = "value_not_finite"
META_NOT_OBJECT = "meta_not_object"

EVENT_STATUSES = ("pending", "processed", "failed")
RUN_STATUSES = ("running", "completed", "failed")

# Decimal numbers and the names of non-finite ones; keeps out forms such as 1d or 0x1p3.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NON_FINITE_PATTERN = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def number(text: Column) -> Column:
    """Text to double, NULL when it is not a number; infinities and NaN come back as such."""
    plain = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    other = F.when(
        text.rlike(NON_FINITE_PATTERN),
        F.when(F.lower(text).contains("nan"), F.lit("NaN")).otherwise(F.lit("Infinity")).try_cast("double"),
    )
    return F.coalesce(plain, other)


def finite(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it is named here rather than left to the range."""
    return ~F.isnan(value) & value.between(-MAX_ABS_VALUE, MAX_ABS_VALUE)


def metric_length_ok(metric: Column) -> Column:
    return F.length(metric).between(1, MAX_METRIC_LENGTH)


def status_ok(status: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(status.isin(*allowed), F.lit(False))


def reject_reason(
    metric: Column, timestamp: Column, timestamp_is_number: Column, value: Column, event_us: Column, parsed: Column
) -> Column:
    """The first failed check of a row, NULL for a good one."""
    return (
        F.when(metric.isNull() | timestamp.isNull() | value.isNull(), F.lit(MISSING_FIELD))
        .when(timestamp_is_number & ~F.coalesce(epoch_in_range(timestamp.try_cast("double")), F.lit(False)), F.lit(TIMESTAMP_RANGE))
        .when(event_us.isNull(), F.lit(TIMESTAMP_FORMAT))
        .when(~metric_length_ok(metric), F.lit(METRIC_LENGTH))
        .when(parsed.isNull(), F.lit(VALUE_TYPE))
        .when(~finite(parsed), F.lit(VALUE_NOT_FINITE))
    )
