"""Streaming jobs: detect, score and route, block SIP sources.

Progress lives in the checkpoint, so a restart neither skips nor repeats a file. Every
micro-batch writes under the name of its stream and its own ``batch_id``, and overwrites only
that on a retry; streams may share a root.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sigwatch.constants import ACTION_BLOCK, ACTION_NOTIFY
from sigwatch.operators.actions import (
    alert_payload, notice_payload, score_results, sip_alert_payload,
)
from sigwatch.operators.lists import block_additions, valid_candidates
from sigwatch.operators.rules import detect
from sigwatch.operators.sip import flatten_events
from sigwatch.operators.training import score
from sigwatch.schemas import feature_table
from sigwatch.sources.tables import by_name, parse_ids_events, text_schema
from sigwatch.streaming.keyed import LAST, KeyedTable, folders


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv",
                files_per_batch: int = 1, archive: str | None = None,
                delete: bool = False, required: Sequence[str] = ()) -> DataFrame:
    """New files, oldest first, with their name; done files may be archived or deleted.

    CSV columns go by the header of the files there when the stream starts, or else by the
    declared order; a file with another header stops the stream.
    """
    names = _header(spark, path) if kind == "csv" else []
    names = names or schema.names
    reader = (spark.readStream.format(kind).schema(text_schema(names) if kind == "csv" else schema)
              .option("header", True).option("enforceSchema", False)
              .option("maxFilesPerTrigger", files_per_batch))
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif delete:
        reader = reader.option("cleanSource", "delete")
    source = F.col("_metadata.file_name").alias("source_file")
    rows = reader.load(path)
    return by_name(rows, names, schema, required, [source]) if kind == "csv" else rows.select("*", source)


def _header(spark: SparkSession, path: str) -> list[str]:
    try:
        return spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        return []


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
          every: str | None = None) -> StreamingQuery:
    """Run ``handle`` per micro-batch: every so often, or once over what is there."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def write_batch(df: DataFrame, path: str, stream: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch_id={batch_id}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table this job appends to; empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _blocked(spark: SparkSession, root: str, stream: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/blocklist/{stream}", "ip string, batch_id int", "ip")


def _blocked_by_all(spark: SparkSession, root: str, own: str | None = None, before: int = 0,
                    keys: DataFrame | None = None) -> DataFrame:
    """Ip, stream and batch of what streams have blocked, the ``own`` one before a batch."""
    empty = spark.createDataFrame([], "ip string, batch_id int, stream string")
    return reduce(DataFrame.unionByName, [
        _blocked(spark, root, name).read(before if name == own else LAST, keys).withColumn("stream", F.lit(name))
        for name in folders(spark, f"{root}/blocklist")], empty)


def add_to_blocklist(candidates: DataFrame, root: str, stream: str, batch_id: int) -> None:
    """Idempotent: addresses blocked by other batches, of any stream, are left out. Only the
    buckets that the candidates fall into are read."""
    spark = candidates.sparkSession
    wanted = valid_candidates(candidates, "src_ip").persist()
    try:
        known = _blocked_by_all(spark, root, stream, batch_id, wanted)
        new = block_additions(wanted, known, "ip").withColumn("batch_id", F.lit(batch_id))
        _blocked(spark, root, stream).write(new, batch_id)
    finally:
        wanted.unpersist()


def blocklist(spark: SparkSession, root: str) -> DataFrame:
    return _blocked_by_all(spark, root).select("ip").distinct()


def detection_handler(root: str, addresses: DataFrame | None = None,
                      ranges: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Label each batch of features, by the lists given; write labels and alerts."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        labelled = detect(batch, addresses, ranges).persist()
        try:
            write_batch(labelled, f"{root}/labelled", "detection", batch_id)
            alerts = labelled.where("label = 1").select(
                alert_payload(F.col("src_ip"), F.current_timestamp(), F.col("main_threat"))
                .alias("value"))
            write_batch(alerts, f"{root}/alerts", "detection", batch_id)
        finally:
            labelled.unpersist()
    return handle


def scoring_handler(root: str, model: PipelineModel) -> Callable[[DataFrame, int], None]:
    """Score the anomalous rows of each batch and route them by action."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch.where("label = 1"), model)
        results = score_results(scored, "score").persist()
        try:
            write_batch(results, f"{root}/results", "scoring", batch_id)
            ip = F.col("ip_origen")
            notices = results.where(F.col("accion") == ACTION_NOTIFY).select(
                notice_payload(ip, F.current_timestamp()).alias("value"))
            write_batch(notices, f"{root}/notices", "scoring", batch_id)
            blocked = results.where(F.col("accion") == ACTION_BLOCK).select(ip.alias("src_ip"))
            add_to_blocklist(blocked, root, "scoring", batch_id)
        finally:
            results.unpersist()
    return handle


def sip_handler(root: str) -> Callable[[DataFrame, int], None]:
    """Flow rows, alerts and blocked sources of each batch of IDS events."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        flows = flatten_events(batch).persist()
        try:
            write_batch(flows, f"{root}/flows", "sip", batch_id)
            write_batch(sip_alert_payload(flows), f"{root}/alerts", "sip", batch_id)
            add_to_blocklist(flows.where("label = 1"), root, "sip", batch_id)
        finally:
            flows.unpersist()
    return handle


def start_detection(spark: SparkSession, inbox: str, root: str, every: str | None = None,
                    addresses: DataFrame | None = None, ranges: DataFrame | None = None,
                    **source) -> StreamingQuery:
    stream = file_stream(spark, inbox, feature_table(), **source)
    return start(stream, detection_handler(root, addresses, ranges),
                 f"{root}/_checkpoint_detection", every)


def start_scoring(spark: SparkSession, inbox: str, root: str, model: PipelineModel,
                  every: str | None = "10 seconds", **source) -> StreamingQuery:
    stream = file_stream(spark, inbox, feature_table(), **source)
    return start(stream, scoring_handler(root, model), f"{root}/_checkpoint_scoring", every)


def start_sip(spark: SparkSession, inbox: str, root: str, every: str | None = "10 seconds",
              **source) -> StreamingQuery:
    lines = file_stream(spark, inbox, T.StructType([T.StructField("value", T.StringType())]),
                        kind="text", **source)
    return start(parse_ids_events(lines), sip_handler(root), f"{root}/_checkpoint_sip", every)
