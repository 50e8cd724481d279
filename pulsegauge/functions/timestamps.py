"""Event time in its two input forms: ISO-8601 text and Unix seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.config import MICROS

# Accepted range of numeric timestamps, 2000-01-01 to 2100-01-01.
EPOCH_MIN_SECONDS = 946684800
EPOCH_MAX_SECONDS = 4102444800

# The ISO-8601 calendar forms. Groups: year, dash, month, day, hour, colon, minute,
# second, fraction, offset sign, offset hour, offset colon, offset minute, offset second.
ISO_PATTERN = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:[^\d](\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:([+-])(\d{2})(?:(:?)(\d{2})(?:\12(\d{2}))?)?)?)?$"
)
# The same with a week date, as 2024-W03-2 or 2024W032. Groups: year, dash, week, day.
ISO_WEEK_PATTERN = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(?=$|[^\d])"


ISO_PARTS = "$1-$3-$4|$5|$7|$8|$9|$10|$11|$13|$14"
ISO_WEEK_PARTS = "$1|$3|$4|"


def epoch_in_range(seconds: Column) -> Column:
    return seconds.between(EPOCH_MIN_SECONDS, EPOCH_MAX_SECONDS)


def epoch_to_micros(seconds: Column) -> Column:
    """Unix seconds (double) to epoch microseconds, NULL outside the accepted range."""
    return F.when(epoch_in_range(seconds), F.round(seconds * MICROS).cast("bigint"))


def _with_week_dates_rewritten(df: DataFrame, iso: str) -> DataFrame:
    """Turn a leading ISO week date into YYYY-MM-DD; a week the year does not have becomes NULL."""
    parts = F.when(F.col(iso).rlike(ISO_WEEK_PATTERN), F.split(F.regexp_replace(F.col(iso), ISO_WEEK_PATTERN, ISO_WEEK_PARTS), r"\|"))
    year, week = F.col("_week")[0], F.col("_week")[1].try_cast("int")
    day = F.coalesce(F.col("_week")[2].try_cast("int"), F.lit(1))
    monday = F.date_add(F.trunc(F.concat(year, F.lit("-01-04")).try_cast("date"), "week"), (week - 1) * 7)
    # the Thursday decides which year a week belongs to
    valid = week.between(1, 53) & (F.year(F.date_add("_monday", 3)) == year.try_cast("int"))
    rewritten = F.when(F.col("_week").isNull(), F.col(iso)).when(
        valid, F.concat(F.date_format(F.date_add("_monday", day - 1), "yyyy-MM-dd"), F.col("_week")[3])
    )
    return df.withColumn("_week", parts).withColumn("_monday", monday).withColumn(iso, rewritten).drop("_week", "_monday")


def add_event_micros(df: DataFrame, text: str, numeric: Column, out: str = "event_us") -> DataFrame:
    """Add epoch microseconds of a timestamp field, NULL when it is not acceptable.

    Where ``numeric`` holds, the field is Unix seconds within the accepted range. Elsewhere it is
    ISO-8601 text: at least a full calendar date (a plain cast would also take a year or a month
    alone), ``Z`` means UTC, and text without an offset is read as UTC in every session time zone.

    The text is matched once and cut into its parts in a column of its own; doing it in a single
    expression would repeat the match for each part and outgrow generated code.
    """
    iso = df.withColumn("_iso", F.regexp_replace(F.col(text), "Z", "+00:00"))
    iso = _with_week_dates_rewritten(iso, "_iso")
    parts = F.when(F.col("_iso").rlike(ISO_PATTERN), F.split(F.regexp_replace("_iso", ISO_PATTERN, ISO_PARTS), r"\|", -1))
    cut = iso.withColumn("_p", parts)
    p = F.col("_p")
    instant = F.concat(
        p[0], F.lit("T"), F.lpad(p[1], 2, "0"), F.lit(":"), F.lpad(p[2], 2, "0"), F.lit(":"), F.lpad(p[3], 2, "0"),
        F.lit("."), F.rpad(p[4], 6, "0"), F.lit("Z"),
    )
    number = lambda i: F.lpad(p[i], 2, "0").cast("int")
    inside = (number(6) <= 23) & (number(7) <= 59) & (number(8) <= 59) & ~p[0].startswith("0000")
    shift = ((number(6) * 60 + number(7)) * 60 + number(8)).cast("bigint") * MICROS
    read = cut.withColumn("_utc", F.when(inside, F.unix_micros(F.try_to_timestamp(instant))))
    from_text = F.col("_utc") - F.when(p[5] == "-", -shift).otherwise(shift)
    from_number = epoch_to_micros(F.col(text).try_cast("double"))
    return read.withColumn(out, F.when(numeric, from_number).otherwise(from_text)).drop("_iso", "_p", "_utc")


def micros_to_iso(event_us: str | Column) -> Column:
    """UTC ISO text; the fraction is left out when it is zero."""
    us = F.col(event_us) if isinstance(event_us, str) else event_us
    # a zone-free timestamp prints the same text in every session time zone
    seconds = F.floor((us - F.pmod(us, F.lit(MICROS))) / MICROS).cast("bigint")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    short = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.lpad(F.pmod(us, F.lit(MICROS)).cast("string"), 6, "0")
    return F.when(F.pmod(us, F.lit(MICROS)) == 0, short).otherwise(F.concat(short, F.lit("."), fraction))
