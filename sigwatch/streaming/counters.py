"""Counters over unbounded streams.

``windowed_counts`` and ``rate_alerts`` combine on the map side. The row-by-row counters handle
each micro-batch with the sliced batch operators, so that a key with a large share of a batch is
cut like any heavy key, and carry one small row per key from batch to batch in a
:class:`~sigwatch.streaming.keyed.KeyedTable`. Limit what one trigger takes in to bound a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sigwatch.operators.features import MICROS, message_count, micros
from sigwatch.operators.sip import anchored_windows, source_of, tumbling_rate
from sigwatch.operators.skew import AT, KEY, TARGET_ROWS, key_text, keyed_rows
from sigwatch.streaming.jobs import start, write_batch
from sigwatch.streaming.keyed import KeyedTable


def windowed_counts(stream: DataFrame, key: str = "c_imsi", ts: str = "ts",
                    window: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Messages per key and window, for the update or append mode."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, window), key)
            .agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n"))


def rate_alerts(stream: DataFrame, matches: Column, source: str, count: int, window: str,
                ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Streaming form of the tumbling rate rule."""
    return tumbling_rate(stream.withWatermark(ts, late), matches, source, count, window, ts)


def counts_of(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/counts", "key string, n long, last_us long", "key")


def count_handler(root: str, key: str = "c_imsi", idle_seconds: int = 86_400, tie: str = "event_id", ts: str = "ts",
                  target_rows: float = TARGET_ROWS) -> Callable[[DataFrame, int], None]:
    """Adds the 1-based count per key, ``f_msg_count_per_imsi``, to each micro-batch.

    Within a batch rows count in the order of (ts, tie), heavy keys in slices. A key goes on from
    where the last batch left it, unless its first row comes more than ``idle_seconds`` after its
    last one. Rows go to ``{root}/counted``.
    """
    idle, name = idle_seconds * MICROS, "f_msg_count_per_imsi"

    def handle(batch: DataFrame, batch_id: int) -> None:
        table = counts_of(batch.sparkSession, root)
        rows = batch.withColumn("_counted_by", key_text(key)).withColumn("_us", micros(ts)).persist()
        try:
            own = rows.groupBy(F.col("_counted_by").alias("key")).agg(
                F.count("*").alias("own"), F.min("_us").alias("first"), F.max("_us").alias("last")).persist()
            going = (own.join(table.read(batch_id, own), "key", "left")
                     .withColumn("n", F.when(F.col("first") - F.col("last_us") <= idle, F.col("n")).otherwise(0)))
            counted = message_count(rows, [key], ts, tie, target_rows)
            # One row per key on the right: a heavy key's rows are split as a skewed partition.
            found = counted.join(going.select(F.col("key").alias("_counted_by"), "n"), "_counted_by").withColumn(
                name, F.col(name) + F.col("n"))
            write_batch(found.select(*batch.columns, name), f"{root}/counted", "counts", batch_id)
            latest = F.greatest("last", F.when(F.col("n") > 0, F.col("last_us")).otherwise(F.lit(None))).alias("last_us")
            reached = own.agg(F.max("last")).first()[0]
            table.write(going.select("key", (F.col("own") + F.col("n")).alias("n"), latest), batch_id,
                        F.col("last_us") + idle >= F.lit(reached) if reached is not None else None)
            own.unpersist()
        finally:
            rows.unpersist()
    return handle


def running_counts(stream: DataFrame, root: str, every: str | None = None, **options) -> StreamingQuery:
    """Start :func:`count_handler` over a stream; rows without a time count as the earliest."""
    return start(stream, count_handler(root, **options), f"{root}/_checkpoint_counts", every)


def open_windows(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/windows", "key string, start long, n long", "key")


def threshold_handler(root: str, matches: Column, source: str, count: int, seconds: int, ts: str = "ts",
                      target_rows: float = TARGET_ROWS) -> Callable[[DataFrame, int], None]:
    """Anchored threshold windows; one alert per window, in the batch that reaches the count.

    A source's last window stays open for the next batch. Rows before it belong to no window.
    Alerts go to ``{root}/alerts``.
    """
    width = seconds * MICROS

    def handle(batch: DataFrame, batch_id: int) -> None:
        table = open_windows(batch.sparkSession, root)
        timed = keyed_rows(batch.where(matches), [source], micros(ts)).select(KEY, AT).where(F.col(AT).isNotNull()).persist()
        try:
            keys = timed.select(F.col(KEY).alias("key")).distinct()
            opened = table.read(batch_id, keys).select(
                F.col("key").alias(KEY), F.col("start").alias("opened"), F.col("n").alias("held"))
            found = anchored_windows(timed, count, width, target_rows, opened).persist()
            alerts = found.where(F.col("alert").isNotNull()).select(
                source_of(source), F.timestamp_micros("start").alias("window_start"),
                F.timestamp_micros("alert").alias("alert_at"))
            write_batch(alerts, f"{root}/alerts", "threshold", batch_id)
            reached = found.agg(F.max("start")).first()[0]
            table.write(found.groupBy(F.col(KEY).alias("key")).agg(
                F.max("start").alias("start"), F.max_by("n", "start").alias("n")), batch_id,
                F.col("start") + width >= F.lit(reached) if reached is not None else None)
            found.unpersist()
        finally:
            timed.unpersist()
    return handle


def threshold_alerts(stream: DataFrame, root: str, matches: Column, source: str, count: int, seconds: int,
                     every: str | None = None, **options) -> StreamingQuery:
    """Start :func:`threshold_handler` over a stream."""
    return start(stream, threshold_handler(root, matches, source, count, seconds, **options),
                 f"{root}/_checkpoint_threshold", every)
