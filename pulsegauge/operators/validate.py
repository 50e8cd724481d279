"""Raw fields to events and quarantine, duplicate removal, and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.functions import checks
from pulsegauge.functions.identity import event_id
from pulsegauge.functions.timestamps import add_event_micros, micros_to_iso
from pulsegauge.schema import EVENT_COLUMNS

QUARANTINE_COLUMNS = ("source", "row_num", "raw", "reason")


def checked_messages(messages: DataFrame, text: str = "raw") -> DataFrame:
    """Validate JSON messages; every input row comes back with a ``reason`` (NULL when good).

    The message is parsed once as VARIANT, because a timestamp sent as a number and one sent as a
    string of digits follow different rules, and reading the field as a string hides which it was.
    Of a repeated key the last value counts, which is a setting of the session.
    """
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    names = ("metric", "timestamp", "value", "meta")
    doc = messages.withColumn("doc", F.try_parse_json(F.col(text)))
    field = lambda name: F.to_json(F.try_variant_get("doc", f"$.{name}", "variant"))
    typed = doc.select("*", *[field(n).alias(f"{n}_json") for n in names]).withColumns(
        {
            "metric_text": F.try_variant_get("doc", "$.metric", "string"),
            **{f"{n}_text": F.trim(F.col(f"{n}_json"), F.lit('"')) for n in ("timestamp", "value")},
        }
    )
    begins = lambda name, chars: F.coalesce(F.substring(f"{name}_json", 1, 1).isin(*chars), F.lit(False))
    # a field is absent or JSON null; other JSON values tell their type by the first character
    void = lambda name: F.coalesce(F.col(f"{name}_json") == "null", F.lit(True))
    nested = lambda name: begins(name, "{[")
    is_number = begins("timestamp", "-0123456789")
    value = (
        F.when(F.col("value_json") == "true", F.lit(1.0))
        .when(F.col("value_json") == "false", F.lit(0.0))
        .otherwise(checks.number(F.col("value_text")))
    )
    ready = add_event_micros(typed, "timestamp_text", is_number).withColumn("parsed_value", value)
    missing = lambda name: F.when(~void(name), F.col(f"{name}_text"))
    reason = (
        F.when(F.col("doc").isNull(), F.lit(checks.INVALID_JSON))
        .when(~F.ltrim(F.col(text)).startswith("{"), F.lit(checks.NOT_AN_OBJECT))
        .when(void("metric") | void("timestamp") | void("value"), F.lit(checks.MISSING_FIELD))
        .when(nested("metric"), F.lit(checks.METRIC_TYPE))
        .when(nested("timestamp") | begins("timestamp", "tf"), F.lit(checks.TIMESTAMP_TYPE))
        .when(nested("value"), F.lit(checks.VALUE_TYPE))
        .otherwise(
            F.coalesce(
                checks.reject_reason(
                    missing("metric"), missing("timestamp"), is_number, missing("value"),
                    F.col("event_us"), F.col("parsed_value"),
                ),
                F.when(~void("meta") & ~begins("meta", "{"), F.lit(checks.META_NOT_OBJECT)),
            )
        )
    )
    return _finish(
        ready.withColumn("reason", reason),
        metric=F.col("metric_text"),
        meta=F.when(~void("meta"), F.col("meta_json")),
        raw=F.col(text),
    )


def checked_fields(rows: DataFrame, allow_epoch: bool = False) -> DataFrame:
    """Validate rows read from files: string columns ``metric, value, timestamp, meta``.

    A timestamp in a file is text, so epoch numbers are refused unless ``allow_epoch`` is set.
    Metadata that is not JSON counts as empty; JSON that is not an object spoils the row.
    """
    trimmed = rows.withColumns({"metric": F.trim("metric"), "timestamp": F.trim("timestamp")})
    digits = F.coalesce(F.col("timestamp").rlike(checks.NUMBER_PATTERN), F.lit(False))
    is_number = digits & ~F.col("timestamp").rlike(r"^\d{8}$") if allow_epoch else F.lit(False)
    meta_doc = F.try_parse_json("meta")
    meta_kind = F.schema_of_variant(meta_doc)
    ready = add_event_micros(trimmed, "timestamp", is_number).withColumns(
        {"parsed_value": checks.number(F.col("value")), "meta_kind": meta_kind}
    )
    bad_meta = F.coalesce(~F.col("meta_kind").rlike("^(OBJECT|VOID)"), F.lit(False))
    reason = F.coalesce(
        checks.reject_reason(
            F.col("metric"), F.col("timestamp"), is_number, F.col("value"), F.col("event_us"), F.col("parsed_value")
        ),
        F.when(bad_meta, F.lit(checks.META_NOT_OBJECT)),
    )
    meta = F.when(F.col("meta_kind").startswith("OBJECT"), F.to_json(meta_doc)).when(
        F.coalesce(F.col("meta_kind"), F.lit("")) != "VOID", F.lit("{}")
    )
    return _finish(ready.withColumn("reason", reason), F.col("metric"), meta, F.col("raw"))


def _finish(df: DataFrame, metric: Column, meta: Column, raw: Column) -> DataFrame:
    keep = ("source", "row_num")
    have = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in zip(keep, ("string", "bigint"))]
    # Generated columns keep a later filter on the reason above this point. Pushed below, the filter
    # would be rewritten in terms of the raw text and repeat the parsing once per use of a part.
    verdict = F.struct(
        "event_us", metric.alias("metric"), F.col("parsed_value").alias("value"), meta.alias("meta_json"), "reason"
    )
    out = df.select(*have, raw.alias("raw"), F.inline(F.array(verdict)))
    return out.withColumns(
        {"event_ts": F.timestamp_micros("event_us"), "event_id": event_id("metric", "event_us", "value")}
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).select(*EVENT_COLUMNS)


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).select(*QUARANTINE_COLUMNS)


def serialize(events: DataFrame) -> DataFrame:
    """Events as the JSON text that travels in a queue or topic, beside their key columns."""
    message = F.to_json(
        F.struct(
            micros_to_iso("event_us").alias("timestamp"), "metric", "value", F.try_parse_json("meta_json").alias("meta")
        )
    )
    return events.select("event_id", "metric", message.alias("raw"))


def deduplicate(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One event per ``event_id``: the first in ``order``.

    An aggregate, so copies are reduced before the shuffle and an id with very many copies does
    not gather in one task. Opt-in: two real events equal in metric, time and value share an id.
    """
    columns = [c for c in events.columns if c != "event_id"]
    first = F.min_by(F.struct(*columns), F.struct(*(order or columns)))
    return events.groupBy("event_id").agg(first.alias("kept")).select("event_id", "kept.*").select(*events.columns)


def deduplicate_stream(events: DataFrame, delay: str) -> DataFrame:
    """Streaming form: copies arriving within ``delay`` of each other are dropped."""
    return events.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def backlog(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Events taken in but not yet processed."""
    return raw.join(processed.select("event_id"), "event_id", "left_anti")


def status_violations(df: DataFrame, allowed: tuple[str, ...], key: str) -> DataFrame:
    """Rows whose status is outside its closed domain."""
    return df.filter(~checks.status_ok(F.col("status"), allowed)).select(
        F.col(key).cast("string").alias("key"), F.lit("status").alias("rule"), F.col("status").cast("string").alias("found")
    )


def result_violations(results: DataFrame, key: str = "event_id") -> DataFrame:
    """Results whose score is missing or outside [0, 1]."""
    score = F.col("anomaly_score")
    bad = score.isNull() | F.isnan(score) | ~score.between(0.0, 1.0)
    return results.filter(bad).select(
        F.col(key).cast("string").alias("key"), F.lit("anomaly_score").alias("rule"), score.cast("string").alias("found")
    )


def run_violations(runs: DataFrame) -> DataFrame:
    """Runs that break a rule, one row per broken rule: status, negative counts, too many anomalies."""
    events, anomalies = F.col("event_count"), F.col("anomaly_count")
    rules = F.array(
        F.when(~checks.status_ok(F.col("status"), checks.RUN_STATUSES), F.struct(F.lit("status").alias("rule"), F.col("status").alias("found"))),
        F.when(events < 0, F.struct(F.lit("event_count").alias("rule"), events.cast("string").alias("found"))),
        F.when(anomalies < 0, F.struct(F.lit("anomaly_count").alias("rule"), anomalies.cast("string").alias("found"))),
        F.when(anomalies > events, F.struct(F.lit("anomaly_count_exceeds").alias("rule"), anomalies.cast("string").alias("found"))),
    )
    return runs.select(F.col("run_id").cast("string").alias("key"), F.inline(F.filter(rules, lambda r: r.isNotNull())))


def empty_batches(batches: DataFrame, events: DataFrame) -> DataFrame:
    """Announced batches that hold no event."""
    return batches.join(events.select("batch_id"), "batch_id", "left_anti")
