"""Streams over files written from the tables, each run over what is there and read back.

The checks are those of the batch twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwatch.operators.sip import is_invite
from sigwatch.plans import sip as sip_plans  # noqa: F401  its SQL is shared
from sigwatch.plans.registry import CHECKS, query
from sigwatch.plans.sliced import SHARE
from sigwatch.plans.views import SIG, ids_lines, sig, sip_messages, table
from sigwatch.session import shared_dir
from sigwatch.sources.tables import read_csv, write_csv
from sigwatch.streaming import counters, jobs


def _in_portions(rows, start, portions=3):
    """Write rows in order of time, one portion after the other, and let a stream that ``start``
    starts take in each: it resumes where it stopped."""
    spark = rows.sparkSession
    inbox, root = shared_dir(spark, "inbox"), shared_dir(spark, "stream")
    at = F.unix_micros("ts")
    cuts = rows.select(at.cast("double").alias("at")).approxQuantile("at", [i / portions for i in range(1, portions)], 0.01)
    edges = [float("-inf"), *cuts, float("inf")]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{inbox}/*")
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        rows.where((at >= a) & (at < b)).write.parquet(f"{inbox}/{n}")
        start(stream, root).awaitTermination()
    return root


@query("csv_by_header", """SELECT event_id, CAST(user_id AS VARCHAR) AS c_imsi, value,
 CAST(NULL AS VARCHAR) AS absent FROM events""")
def csv_by_header(spark, sf_dir):
    """Columns in another order than declared, one too many and one missing."""
    rows = table(spark, sf_dir, "events").selectExpr("value", "event_type AS other", "CAST(user_id AS STRING) AS c_imsi",
                                                     "event_id")
    path = shared_dir(spark, "headers")
    write_csv(rows, path)
    declared = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("c_imsi", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("absent", T.StringType())])
    return read_csv(spark, path, declared, required=["event_id", "c_imsi"])


@query("stream_running_count", f"""WITH {SIG} SELECT event_id, c_imsi, row_number() OVER
 (PARTITION BY c_imsi ORDER BY ts, event_id) AS f_msg_count_per_imsi FROM sig""")
def stream_running_count(spark, sf_dir):
    """The tables' largest keys are cut in every batch."""
    rows = sig(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "c_imsi")
    root = _in_portions(rows, lambda stream, root: counters.running_counts(
        stream, root, target_rows=SHARE, idle_seconds=10 ** 9))
    counted = jobs.read_table(spark, f"{root}/counted", T.StructType(
        [*rows.schema.fields, T.StructField("f_msg_count_per_imsi", T.LongType())]))
    return counted.select("event_id", "c_imsi", "f_msg_count_per_imsi")


_EXACT = CHECKS["threshold_window_exact"].replace(", n_messages\nFROM placed", "\nFROM placed")


@query("stream_threshold_alerts", _EXACT)
def stream_threshold_alerts(spark, sf_dir):
    rows = sip_messages(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    root = _in_portions(rows, lambda stream, root: counters.threshold_alerts(
        stream, root, is_invite(F.col("msg")), "src", 3, 21_600, target_rows=SHARE))
    alerts = jobs.read_table(spark, f"{root}/alerts", "src string, window_start timestamp, alert_at timestamp")
    return alerts.select("src", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "alert_at")])


def _sip_job(spark, sf_dir):
    inbox, root = shared_dir(spark, "lines"), shared_dir(spark, "sip")
    ids_lines(spark, sf_dir).select("line").write.text(inbox)
    jobs.start_sip(spark, inbox, root, every=None, files_per_batch=1000).awaitTermination()
    return root


@query("stream_sip_blocks", CHECKS["sip_block_sources"])
def stream_sip_blocks(spark, sf_dir):
    """IDS lines through the SIP stream; the addresses it blocks."""
    return jobs.blocklist(spark, _sip_job(spark, sf_dir))


@query("stream_sip_alerts", CHECKS["sip_alert_payload"])
def stream_sip_alerts(spark, sf_dir):
    root = _sip_job(spark, sf_dir)
    return jobs.read_table(spark, f"{root}/alerts", "value string").select("value")
