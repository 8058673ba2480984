"""SIP events and messages: flattening, content rules and rate rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sigwatch.constants import DEFAULT_SIP_ALERT, SIP_CLASS_SEVERITY, SIP_RULES
from sigwatch.operators.features import micros
from sigwatch.operators.lists import fixed_table
from sigwatch.operators.skew import (
    AT, KEY, SLICE, TARGET_ROWS, Sliced, Slicing, add_previous_row, add_running_sums, find_slicing,
    heavy_only, keyed_rows, slice_rows,
)
from sigwatch.session import stored

UNKNOWN_METHOD = r"(?im)^(?!INVITE|REGISTER|BYE|OPTIONS\s)[A-Z]+\s+sip:"


def flatten_events(events: DataFrame) -> DataFrame:
    """Nested IDS events as flow rows; an empty alert object is no alert."""
    alerted = F.coalesce(F.size("alert") > 0, F.lit(False))
    message = F.coalesce(F.col("alert").getItem("signature"), F.lit(DEFAULT_SIP_ALERT))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("timestamp", "src_ip", "dest_ip", "proto")]
    return events.select(*texts, F.when(alerted, 1).otherwise(0).alias("label"),
                         F.when(alerted, message).otherwise("").alias("alert_msg"))


def is_invite(message: Column) -> Column:
    return message.contains("INVITE")


def is_register(message: Column) -> Column:
    return message.contains("REGISTER")


def is_unknown_method(message: Column) -> Column:
    return message.contains("SIP/2.0") & message.rlike(UNKNOWN_METHOD)


def is_bad_agent(message: Column) -> Column:
    return message.contains("User-Agent:") & F.lower(message).contains("sqlmap")


def tumbling_rate(messages: DataFrame, matches: Column, source: str, count: int, window: str,
                  ts: str = "ts") -> DataFrame:
    """Sources with at least ``count`` matching messages in a fixed window, once per window."""
    return (messages.where(matches)
            .groupBy(F.window(ts, window).alias("_window"), source)
            .agg(F.count("*").alias("n_messages")).where(F.col("n_messages") >= count)
            .select(F.col("_window.start").alias("window_start"), source, "n_messages"))


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(sid, cls, text, SIP_CLASS_SEVERITY[cls]) for sid, cls, text in SIP_RULES]
    table = fixed_table(spark, rows, ["sid", "classtype", "msg", "severity"])
    return table.withColumn("severity", F.col("severity").cast("int"))


def content_alerts(messages: DataFrame, text: str) -> DataFrame:
    """One row per message and content rule it meets."""
    found = F.array_compact(F.array(
        F.when(is_unknown_method(F.col(text)), F.lit(1000003).cast("bigint")),
        F.when(is_bad_agent(F.col(text)), F.lit(1000004).cast("bigint"))))
    return messages.withColumn("sid", F.explode(found))


def classify(alerts: DataFrame) -> DataFrame:
    """Class, message and severity of each alert by rule id (four fixed rules)."""
    return alerts.join(F.broadcast(rule_table(alerts.sparkSession)), "sid")


# Threshold windows anchored at the first event: a window opens at the first event, lasts a
# fixed width, and the first event after its end opens the next.
#
# Sources that are not heavy are walked window by window over their sorted moments. A heavy source
# is never gathered: each of its moments finds the moment that would open the next window, by the
# sliced look-up of the nearest row; jumps over 1, 2, 4, ... windows come from joining these
# successors with themselves, and applying the jumps from the longest to the shortest to the first
# moment reaches every moment that opens a window. Each moment then looks up its window, and
# running sums over slices tell which one reaches the count.

WINDOWS = f"{KEY} string, start bigint, gained bigint, alert bigint"


def _walk(width: int, count: int):
    """Windows of sources over moments sorted by key and time; a window may come in parts."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, so_far = None, None, 0
        for pdf in batches:
            keys, at, held = pdf[KEY].to_numpy(), pdf[AT].to_numpy(np.int64), pdf["held"].to_numpy()
            seen, opened = np.append(0, pdf["n"].to_numpy(np.int64).cumsum()), pdf["opened"].to_numpy()
            rows = []
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for first, behind in zip([0, *edges], [*edges, len(keys)] if len(keys) else []):
                i, extra = first, 0
                if keys[first] != current:
                    current, start, so_far = keys[first], None, 0
                    if not np.isnan(opened[first]):
                        start, so_far = int(opened[first]), int(held[first])
                        extra = so_far
                        # What came before the open window belongs to none still to come.
                        i += int(np.searchsorted(at[first:behind], start))
                while i < behind:
                    if start is None or at[i] >= start + width:
                        start, so_far, extra = int(at[i]), 0, 0
                    end = first + int(np.searchsorted(at[first:behind], start + width))
                    gained, alert = int(seen[end] - seen[i]), None
                    if so_far < count <= so_far + gained:
                        alert = int(at[i + int(np.searchsorted(seen[i + 1:end + 1], seen[i] + count - so_far))])
                    rows.append((current, start, gained + extra, alert))
                    so_far, i, extra = so_far + gained, end, 0
            yield pd.DataFrame(rows, columns=[KEY, "start", "gained", "alert"]).astype({"alert": "Int64"})
    return walk


def _long_enough(moments: DataFrame, count: int, width: int) -> DataFrame:
    """Drop runs of a source that are too short to raise an alert.

    A pause of a whole width ends any window, so runs between pauses stand alone.
    """
    order = Window.partitionBy(KEY).orderBy(AT)
    pause = F.col(AT) - F.lag(AT).over(order) >= width
    numbered = moments.withColumn("_run", F.sum(F.coalesce(pause, F.lit(False)).cast("int")).over(order))
    size = F.sum("n").over(Window.partitionBy(KEY, "_run"))
    return numbered.withColumn("_size", size).where(F.col("_size") >= count).drop("_run", "_size")


def _reversed(slicing: Slicing) -> Slicing:
    return Slicing(slicing.keys, sorted(-cut for cut in slicing.cuts))


def _successors(moments: DataFrame, slicing: Slicing, width: int) -> DataFrame:
    """KEY, a, b: the moment b that opens the next window if one opens at a."""
    backwards = moments.select(KEY, (-F.col(AT)).alias(AT), F.lit(0).alias("probe"), F.lit(None).cast("bigint").alias("a"))
    probes = moments.select(KEY, (-F.col(AT) - width).alias(AT), F.lit(1).alias("probe"), F.col(AT).alias("a"))
    rows = slice_rows(backwards.unionByName(probes), _reversed(slicing))
    found = add_previous_row(Sliced(rows, _reversed(slicing)), "probe", [AT], "_next", F.col("probe") == 0).rows
    return found.where("probe = 1 AND _next IS NOT NULL").select(KEY, "a", (-F.col(f"_next.{AT}")).alias("b"))


def _openers(moments: DataFrame, first: DataFrame, slicing: Slicing, width: int) -> DataFrame:
    """KEY, start: all moments that open a window, given the first one of each key."""
    after = stored(_successors(moments, slicing, width), "successors")
    # Only what is the successor of something, or first, can open a window.
    able = after.select(KEY, F.col("b").alias("a")).unionByName(first.select(KEY, F.col("start").alias("a"))).distinct()
    jumps = [stored(after.join(able, [KEY, "a"], "left_semi"), "jumps")]
    while not jumps[-1].isEmpty():
        further = jumps[-1].select(KEY, F.col("a").alias("b"), F.col("b").alias("c"))
        jumps.append(stored(jumps[-1].join(further, [KEY, "b"]).select(KEY, "a", F.col("c").alias("b")), "jumps"))
    reached = first
    for jump in reversed(jumps[:-1]):
        ahead = reached.join(jump.withColumnRenamed("a", "start"), [KEY, "start"]).select(KEY, F.col("b").alias("start"))
        reached = stored(reached.unionByName(ahead), "openers")
    return reached


def _heavy_windows(moments: DataFrame, slicing: Slicing, count: int, width: int) -> DataFrame:
    """The windows of heavy sources: KEY, start, gained, alert."""
    moments = stored(moments.where(F.col("opened").isNull() | (F.col(AT) >= F.col("opened"))), "moments")
    # An open window's events are there already; the first moment behind its end opens the next.
    first = (moments.where(F.col("opened").isNull() | (F.col(AT) >= F.col("opened") + width))
             .groupBy(KEY).agg(F.min(AT).alias("start")))
    summed = stored(add_running_sums(Sliced(slice_rows(moments, slicing), slicing), {"upto": F.col("n")})
                    .rows.drop(SLICE), "sums")
    marks = (_openers(moments, first, slicing, width).withColumnRenamed("start", AT)
             .join(summed, [KEY, AT]).select(KEY, AT, (F.col("upto") - F.col("n")).alias("before"), F.lit(0).alias("held")))
    going = (moments.where(F.col("opened").isNotNull()).groupBy(KEY)
             .agg(F.min("opened").alias(AT), F.max("held").alias("held"))
             .select(KEY, AT, (-F.col("held")).alias("before"), "held"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("n", "upto")]
    both = (marks.unionByName(going).select(KEY, AT, F.lit(0).alias("event"), "before", "held", *none)
            .unionByName(summed.select(KEY, AT, F.lit(1).alias("event"), F.lit(None).cast("bigint").alias("before"),
                                       F.lit(None).cast("bigint").alias("held"), "n", "upto")))
    window = F.col("_window")
    placed = add_previous_row(Sliced(slice_rows(both, slicing), slicing), "event", [AT, "before", "held"], "_window",
                              F.col("event") == 0).rows.where("event = 1 AND _window IS NOT NULL")
    so_far = F.col("upto") - window["before"]
    crossing = (so_far >= count) & (so_far - F.col("n") < count)
    return placed.groupBy(KEY, window[AT].alias("start")).agg(
        (F.sum("n") + F.max(window["held"])).alias("gained"), F.min(F.when(crossing, F.col(AT))).alias("alert"))


def anchored_windows(timed: DataFrame, count: int, width: int, target_rows: float = TARGET_ROWS,
                     opened: DataFrame | None = None, all_windows: bool = True) -> DataFrame:
    """KEY, start, n, alert (the moment that brings the window to ``count`` events, or null) of
    rows with KEY and AT. ``opened`` (KEY, opened, held) has the windows that are already open, and
    how many events they hold. Unless ``all_windows``, windows that cannot reach the count may be
    left out."""
    slicing = find_slicing(timed, target_rows)
    moments = timed.groupBy(KEY, AT).agg(F.count("*").alias("n"))
    if opened is None:
        moments = moments.withColumns({c: F.lit(None).cast("bigint") for c in ("opened", "held")})
    else:
        moments = moments.join(opened, KEY, "left")
    light = moments.where(~F.col(KEY).isin(slicing.keys)) if slicing.keys else moments
    if not all_windows and opened is None:
        light = _long_enough(light, count, width)
    parts = (light.repartition(KEY).sortWithinPartitions(KEY, AT)
             .mapInPandas(_walk(width, count), WINDOWS))
    if slicing.keys:
        parts = parts.unionByName(_heavy_windows(heavy_only(moments, slicing), slicing, count, width))
    return parts.groupBy(KEY, "start").agg(F.sum("gained").alias("n"), F.min("alert").alias("alert"))


def source_of(name: str) -> Column:
    """The source from its key."""
    return F.nullif(F.col(KEY), F.lit("\u0000")).alias(name)


def threshold_windows(messages: DataFrame, matches: Column, source: str, count: int,
                      window_seconds: int, ts: str = "ts",
                      target_rows: float = TARGET_ROWS) -> DataFrame:
    """One alert per source and window that reaches ``count`` events, at that event's time."""
    timed = keyed_rows(messages.where(matches), [source], micros(ts)).select(KEY, AT)
    found = anchored_windows(timed, count, window_seconds * 1_000_000, target_rows, all_windows=False)
    return found.where(F.col("n") >= count).select(
        source_of(source), F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros("alert").alias("alert_at"), F.col("n").alias("n_messages"))
