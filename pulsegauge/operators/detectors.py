"""Detectors: a verdict per event from the statistics of its window."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegauge.config import (
    DEFAULT_LOWER_PERCENTILE,
    DEFAULT_MIN_COUNT,
    DEFAULT_PERCENTILE_MIN_COUNT,
    DEFAULT_THRESHOLD,
    DEFAULT_UPPER_PERCENTILE,
    check_percentile,
    check_zscore,
)
from pulsegauge.functions.identity import anomaly_id
from pulsegauge.operators.joins import join_summary
from pulsegauge.operators.percentiles import MAX_ROWS_PER_BUCKET, percentile_bounds
from pulsegauge.operators.windows import STATS, instant_stats, window_stats
from pulsegauge.schema import ANOMALY_COLUMNS

ZSCORE = "z-score"
PERCENTILE = "percentile"


class Detector(Protocol):
    """What a detector offers; anything with these three members can take part in a run."""

    method: str

    def score(self, events: DataFrame, window_us: int) -> DataFrame:
        """All events with window statistics, verdict and skip reason."""

    def anomalies(self, events: DataFrame, window_us: int) -> DataFrame:
        """Only the flagged events, with the same columns."""


@dataclass(frozen=True)
class ZScoreDetector:
    """Flags ``|value - mean| / stddev >= threshold``.

    The event is part of its own window, so with ``n`` events ``|z|`` cannot pass
    ``(n - 1) / sqrt(n)``: at the default threshold of 3 nothing is flagged below 11 events.
    """

    threshold: float = DEFAULT_THRESHOLD
    min_count: int = DEFAULT_MIN_COUNT
    slices: int | None = None
    strategy: str = "sliced"

    method = ZSCORE

    def __post_init__(self) -> None:
        check_zscore(self.threshold, self.min_count)

    def params(self) -> dict[str, float]:
        return {"threshold": float(self.threshold), "min_count": self.min_count}

    def verdict(self, with_stats: DataFrame) -> DataFrame:
        """Add ``z_score, is_anomaly, skip_reason``; the guards apply in this order."""
        skip = F.when(F.col("window_count") < self.min_count, F.lit("insufficient_data")).when(
            F.col("stddev") == 0, F.lit("zero_stddev")
        )
        z = F.when(skip.isNull(), (F.col("value") - F.col("mean")) / F.col("stddev"))
        return with_stats.withColumns({"skip_reason": skip, "z_score": z}).withColumn(
            "is_anomaly", F.coalesce(F.abs("z_score") >= self.threshold, F.lit(False))
        )

    def score(self, events: DataFrame, window_us: int) -> DataFrame:
        return self.verdict(window_stats(events, window_us, self.strategy, self.slices))

    def anomalies(self, events: DataFrame, window_us: int) -> DataFrame:
        """Flagged events only.

        Instants are judged first, by their smallest and largest value, and just the few that
        hold a flagged event are joined back. Names, ids and metadata of the other events never
        reach a shuffle.
        """
        if self.strategy != "sliced":
            return self.score(events, window_us).filter("is_anomaly")
        far = F.greatest(
            F.abs(F.col("instant_low") - F.col("mean")), F.abs(F.col("instant_high") - F.col("mean"))
        )
        fires = (F.col("window_count") >= self.min_count) & (F.col("stddev") > 0) & (
            far / F.col("stddev") >= self.threshold
        )
        firing = instant_stats(events, window_us, self.slices).filter(fires).select("metric", "event_us", *STATS)
        return self.verdict(events.join(firing, ["metric", "event_us"])).filter("is_anomaly")

    def record_fields(self) -> dict[str, Column]:
        return {
            "z_score": F.col("z_score"),
            "variance": F.col("variance"),
            "threshold": F.lit(float(self.threshold)),
        }


@dataclass(frozen=True)
class PercentileDetector:
    """Flags a value strictly outside the floor-index percentile bounds of its window.

    With the default 1 / 99 a low value needs 100 events in the window and a high one 101.
    """

    lower_percentile: float = DEFAULT_LOWER_PERCENTILE
    upper_percentile: float = DEFAULT_UPPER_PERCENTILE
    min_count: int = DEFAULT_PERCENTILE_MIN_COUNT
    slices: int | None = None
    limit: int = MAX_ROWS_PER_BUCKET

    method = PERCENTILE

    def __post_init__(self) -> None:
        check_percentile(self.lower_percentile, self.upper_percentile, self.min_count)

    def params(self) -> dict[str, float]:
        return {
            "lower_percentile": float(self.lower_percentile),
            "upper_percentile": float(self.upper_percentile),
            "min_count": self.min_count,
        }

    def verdict(self, with_bounds: DataFrame) -> DataFrame:
        skip = F.when(F.col("window_count") < self.min_count, F.lit("insufficient_data"))
        outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
        return with_bounds.withColumn("skip_reason", skip).withColumn(
            "is_anomaly", F.coalesce(F.col("skip_reason").isNull() & outside, F.lit(False))
        )

    def _bounds(self, events: DataFrame, stats: DataFrame, window_us: int, flagged_only: bool) -> DataFrame:
        return percentile_bounds(
            events, stats, window_us, self.lower_percentile, self.upper_percentile, self.min_count,
            flagged_only, self.limit,
        )

    def score(self, events: DataFrame, window_us: int) -> DataFrame:
        stats = instant_stats(events, window_us, self.slices).select("metric", "event_us", *STATS)
        bounds = self._bounds(events, stats, window_us, flagged_only=False)
        known = stats.join(bounds, ["metric", "event_us"], "left")
        return self.verdict(events.join(known, ["metric", "event_us"]))

    def anomalies(self, events: DataFrame, window_us: int) -> DataFrame:
        stats = instant_stats(events, window_us, self.slices)
        bounds = self._bounds(events, stats, window_us, flagged_only=True)
        outside = (F.col("instant_low") < F.col("lower_bound")) | (F.col("instant_high") > F.col("upper_bound"))
        firing = stats.join(bounds, ["metric", "event_us"]).filter(outside)
        firing = firing.select("metric", "event_us", *STATS, "lower_bound", "upper_bound")
        return self.verdict(events.join(firing, ["metric", "event_us"])).filter("is_anomaly")

    def record_fields(self) -> dict[str, Column]:
        return {
            "lower_bound": F.col("lower_bound"),
            "upper_bound": F.col("upper_bound"),
            "lower_percentile": F.lit(float(self.lower_percentile)),
            "upper_percentile": F.lit(float(self.upper_percentile)),
        }


_NULLABLE_DOUBLES = (
    "variance",
    "z_score",
    "threshold",
    "lower_bound",
    "upper_bound",
    "lower_percentile",
    "upper_percentile",
)


def records(flagged: DataFrame, detector: Detector, detected_at: datetime | Column | None = None) -> DataFrame:
    """Anomaly records in one layout for all methods; fields of other methods are NULL.

    ``detected_at`` is an argument so that a rerun can give the same records.
    """
    when = detected_at if isinstance(detected_at, Column) else F.lit(detected_at) if detected_at else F.current_timestamp()
    own = detector.record_fields()
    filled = flagged.select(
        anomaly_id("event_id", F.lit(detector.method)).alias("anomaly_id"),
        "event_id", "metric", "value", "mean", "stddev", "event_us",
        F.col("event_ts").alias("timestamp"),
        "is_anomaly",
        F.lit(detector.method).alias("detection_method"),
        "window_count",
        when.cast("timestamp").alias("detected_at"),
        F.col("meta_json").alias("event_meta"),
        *[own.get(f, F.lit(None)).cast("double").alias(f) for f in _NULLABLE_DOUBLES],
    )
    return filled.select(*ANOMALY_COLUMNS)


def detect(events: DataFrame, detector: Detector, window_us: int, detected_at: datetime | Column | None = None) -> DataFrame:
    """Events in, anomaly records out."""
    return records(detector.anomalies(events, window_us), detector, detected_at)


def detect_all(events: DataFrame, detectors: list[Detector], window_us: int, detected_at: datetime | Column | None = None) -> DataFrame:
    """Records of several detectors over the same events."""
    if not detectors:
        raise ValueError("at least one detector is needed")
    first, *rest = (detect(events, d, window_us, detected_at) for d in detectors)
    for more in rest:
        first = first.unionByName(more)
    return first


def tally(events: DataFrame, detector: Detector, window_us: int) -> DataFrame:
    """One row: how many events were checked, how many flagged, and the parameters."""
    checked = events.agg(F.count(F.lit(1)).alias("total_checked"), F.lit(0).cast("bigint").alias("total_anomalies"))
    flagged = detector.anomalies(events, window_us).agg(
        F.lit(0).cast("bigint").alias("total_checked"), F.count(F.lit(1)).alias("total_anomalies")
    )
    both = checked.unionByName(flagged)
    return both.agg(
        F.lit(detector.method).alias("detection_method"),
        F.sum("total_checked").alias("total_checked"),
        F.sum("total_anomalies").alias("total_anomalies"),
        *[F.lit(v).alias(k) for k, v in detector.params().items()],
    )


def baseline_stats(history: DataFrame, candidates: DataFrame, window_us: int, slices: int | None = None) -> DataFrame:
    """Candidates with the statistics of the history window ending at their own time.

    Candidates take part as instants of weight zero, so they see the history and not each other,
    and the lookup needs neither a range join nor a per-metric group.
    """
    both = history.select("metric", "event_us", "value", F.lit(True).alias("counts")).unionByName(
        candidates.select("metric", "event_us", "value", F.lit(False).alias("counts"))
    )
    if slices is None:
        from pulsegauge.operators.windows import choose_slices

        slices = choose_slices(both, window_us)
    stats = instant_stats(both, window_us, slices, weight=F.col("counts"))
    return candidates.join(stats.select("metric", "event_us", *STATS), ["metric", "event_us"])


def score_candidates(history: DataFrame, candidates: DataFrame, detector: ZScoreDetector, window_us: int) -> DataFrame:
    """Judge values that are not part of the history they are compared with."""
    return detector.verdict(baseline_stats(history, candidates, window_us, detector.slices))


def score_against_snapshot(snapshot: DataFrame, candidates: DataFrame, detector: ZScoreDetector) -> DataFrame:
    """Judge candidates against one fixed row of statistics per metric (see ``snapshot_stats``).

    A candidate of an unknown metric has no baseline and is skipped for lack of data.
    """
    known = join_summary(candidates, snapshot.select("metric", *STATS), ["metric"], "left", ["event_us", "value"]).fillna(
        0, ["window_count", "mean", "variance", "stddev"]
    )
    return detector.verdict(known)
