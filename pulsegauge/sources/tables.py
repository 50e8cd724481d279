"""Parquet tables of metric data as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegauge.schema import events_from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table: one series per event type."""
    return events_from_table(table(spark, sf_dir, "events"), "event_type", "ts", "value", "props", "events")


def shipment_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table: price per return flag over the ship date; many events share a time."""
    return events_from_table(
        table(spark, sf_dir, "lineitem"), "l_returnflag", "l_shipdate", "l_extendedprice", None, "lineitem"
    )


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``orders`` table: total price per priority over the order date."""
    return events_from_table(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", None, "orders"
    )
