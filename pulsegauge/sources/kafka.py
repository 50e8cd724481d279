"""Kafka topics in and out. Reading and writing need the Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegauge.config import GaugeConfig
from pulsegauge.operators.validate import serialize


def source_options(config: GaugeConfig) -> dict[str, str]:
    """Reader options; the checkpoint takes the place of consumer-group offsets.

    Lost offsets stop the query unless ``fail_on_data_loss`` is switched off, and a trigger takes all
    there is unless ``max_offsets_per_trigger`` limits it.
    """
    options = {
        "kafka.bootstrap.servers": config.kafka_bootstrap_servers,
        "subscribe": config.kafka_topic,
        "startingOffsets": config.kafka_starting_offsets,
        "failOnDataLoss": str(config.fail_on_data_loss).lower(),
    }
    if config.max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(config.max_offsets_per_trigger)
    return options


def sink_options(config: GaugeConfig, topic: str | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": config.kafka_bootstrap_servers, "topic": topic or config.kafka_topic}


def messages(kafka_rows: DataFrame) -> DataFrame:
    """Kafka rows as raw messages; topic, partition and offset name the place of a bad one."""
    source = F.concat_ws("/", "topic", F.col("partition").cast("string"))
    return kafka_rows.select(
        source.alias("source"), F.col("offset").alias("row_num"), F.col("value").cast("string").alias("raw")
    )


def read_stream(spark: SparkSession, config: GaugeConfig) -> DataFrame:
    return messages(spark.readStream.format("kafka").options(**source_options(config)).load())


def read_batch(spark: SparkSession, config: GaugeConfig) -> DataFrame:
    """The topic from the configured offsets; a batch cannot begin at the latest, so that means the earliest."""
    options = {k: v for k, v in source_options(config).items() if k != "maxOffsetsPerTrigger"}
    if options["startingOffsets"] == "latest":
        options["startingOffsets"] = "earliest"
    return messages(spark.read.format("kafka").options(**options).load())


def keyed_messages(events: DataFrame) -> DataFrame:
    """Key and value columns of the topic: the metric is the key, the event JSON the value."""
    return serialize(events).select(
        F.col("metric").cast("binary").alias("key"), F.col("raw").cast("binary").alias("value")
    )


def write_batch(events: DataFrame, config: GaugeConfig) -> None:
    keyed_messages(events).write.format("kafka").options(**sink_options(config)).save()
