"""Message topics: a broker when its connector is on the class path, files otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def read_topic(spark: SparkSession, topic: str, servers: str | None = None,
               folder: str | None = None) -> DataFrame:
    """Stream with one text column ``value`` per message."""
    if servers:
        return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("subscribe", topic).option("startingOffsets", "earliest").load()
                .selectExpr("CAST(value AS STRING) AS value"))
    return spark.readStream.format("text").load(f"{folder}/{topic}")


def write_topic(messages: DataFrame, topic: str, checkpoint: str, servers: str | None = None,
                folder: str | None = None) -> DataStreamWriter:
    """Writer of a stream of ``value`` texts; the caller sets the trigger and starts it."""
    writer = messages.select("value").writeStream.option("checkpointLocation", checkpoint)
    if servers:
        return (writer.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("topic", topic))
    return writer.format("text").option("path", f"{folder}/{topic}").outputMode("append")
