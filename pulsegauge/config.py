"""Settings of a detection run, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

MICROS = 1_000_000

# The defaults every run starts from.
DEFAULT_WINDOW_SECONDS = 300.0
DEFAULT_THRESHOLD = 3.0
DEFAULT_MIN_COUNT = 5
DEFAULT_LOWER_PERCENTILE = 1.0
DEFAULT_UPPER_PERCENTILE = 99.0
DEFAULT_PERCENTILE_MIN_COUNT = 20
DEFAULT_ALERT_INTERVAL_SECONDS = 60.0
DEFAULT_RECENT_LIMIT = 100
DEFAULT_CHANNEL = "anomalies"

CONF_PREFIX = "spark.pulsegauge."


def window_micros(window_seconds: float) -> int:
    """Window length in whole microseconds; a window must be positive."""
    if not window_seconds > 0:
        raise ValueError(f"window_seconds must be positive, got {window_seconds}")
    return max(1, round(window_seconds * MICROS))


def check_zscore(threshold: float, min_count: int) -> None:
    if not threshold > 0:
        raise ValueError(f"threshold must be positive, got {threshold}")
    if min_count < 2:
        raise ValueError(f"min_count must be at least 2, got {min_count}")


def check_percentile(lower: float, upper: float, min_count: int) -> None:
    if not 0 <= lower < upper <= 100:
        raise ValueError(f"percentiles must satisfy 0 <= lower < upper <= 100, got {lower}, {upper}")
    if min_count < 10:
        raise ValueError(f"min_count must be at least 10, got {min_count}")


def _parsed(field, text: str):
    """The value of a session key, in the kind of the field's default; a default of None means a whole number."""
    if isinstance(field.default, bool):
        return text.strip().lower() == "true"
    return int(text) if field.default is None else type(field.default)(text)


@dataclass(frozen=True)
class GaugeConfig:
    """One immutable set of run parameters."""

    window_seconds: float = DEFAULT_WINDOW_SECONDS
    threshold: float = DEFAULT_THRESHOLD
    min_count: int = DEFAULT_MIN_COUNT
    lower_percentile: float = DEFAULT_LOWER_PERCENTILE
    upper_percentile: float = DEFAULT_UPPER_PERCENTILE
    percentile_min_count: int = DEFAULT_PERCENTILE_MIN_COUNT
    alert_interval_seconds: float = DEFAULT_ALERT_INTERVAL_SECONDS
    recent_limit: int = DEFAULT_RECENT_LIMIT
    channel: str = DEFAULT_CHANNEL
    kafka_bootstrap_servers: str = "localhost:9092"
    kafka_topic: str = "events"
    kafka_starting_offsets: str = "earliest"
    max_offsets_per_trigger: int | None = None
    fail_on_data_loss: bool = True
    max_files_per_trigger: int = 1_000
    trigger_seconds: float = 1.0

    def __post_init__(self) -> None:
        window_micros(self.window_seconds)
        check_zscore(self.threshold, self.min_count)
        check_percentile(self.lower_percentile, self.upper_percentile, self.percentile_min_count)
        if self.alert_interval_seconds < 0:
            raise ValueError("alert_interval_seconds must not be negative")
        if self.recent_limit < 1:
            raise ValueError("recent_limit must be at least 1")
        if self.kafka_starting_offsets not in ("earliest", "latest"):
            raise ValueError("kafka_starting_offsets must be 'earliest' or 'latest'")

    @property
    def window_us(self) -> int:
        return window_micros(self.window_seconds)

    @property
    def alert_interval_us(self) -> int:
        return round(self.alert_interval_seconds * MICROS)

    @classmethod
    def from_conf(cls, spark, **overrides) -> GaugeConfig:
        """Read ``spark.pulsegauge.<field>`` keys of the session; arguments win over them."""
        found = {}
        for field in fields(cls):
            text = spark.conf.get(CONF_PREFIX + field.name, None)
            if text is not None:
                found[field.name] = _parsed(field, text)
        return cls(**{**found, **overrides})

    def with_(self, **changes) -> GaugeConfig:
        return replace(self, **changes)
