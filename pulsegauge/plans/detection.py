"""End-to-end plans built from the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from pulsegauge.config import GaugeConfig
from pulsegauge.operators.detectors import PercentileDetector, ZScoreDetector, detect, detect_all
from pulsegauge.operators.reports import recent_anomalies


def zscore_detector(config: GaugeConfig) -> ZScoreDetector:
    return ZScoreDetector(config.threshold, config.min_count)


def percentile_detector(config: GaugeConfig) -> PercentileDetector:
    return PercentileDetector(config.lower_percentile, config.upper_percentile, config.percentile_min_count)


def anomaly_records(events: DataFrame, config: GaugeConfig, detected_at: datetime | Column | None = None, both: bool = False) -> DataFrame:
    """Records by z-score, or by z-score and percentile band."""
    if not both:
        return detect(events, zscore_detector(config), config.window_us, detected_at)
    return detect_all(events, [zscore_detector(config), percentile_detector(config)], config.window_us, detected_at)


def newest_anomalies(events: DataFrame, config: GaugeConfig, detected_at: datetime | Column | None = None) -> DataFrame:
    """Events to the most recent anomalies: window, verdict, record, top-k."""
    return recent_anomalies(anomaly_records(events, config, detected_at), config.recent_limit)
