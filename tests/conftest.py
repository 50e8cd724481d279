from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("pulsegauge-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Events from (metric, microseconds, value) tuples."""
    from pyspark.sql import functions as F

    from pulsegauge.functions.identity import event_id

    def make(rows):
        df = spark.createDataFrame(rows, "metric string, event_us bigint, value double")
        return df.select(
            event_id("metric", "event_us", "value").alias("event_id"), "event_us",
            F.timestamp_micros("event_us").alias("event_ts"), "metric", "value",
            F.lit(None).cast("string").alias("meta_json"), F.lit("test").alias("source"),
            F.lit(None).cast("bigint").alias("row_num"),
        )

    return make
