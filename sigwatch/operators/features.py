"""Per-subscriber sequence features over a signalling event table.

Input columns: event id (tie-break), event time, ``c_imsi``, operation name ``op``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigwatch.constants import LOCATION_UPDATES, OPERATIONS
from sigwatch.operators.skew import (
    AT, KEY, SLICE, TARGET_ROWS, Sliced, add_previous_row, add_running_count, carry, cell,
    heavy_only, previous_row, running_count, salted_join, sliced_by, sliding_count,
    sliding_distinct,
)

MICROS = 1_000_000


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def seconds(ts: str = "ts") -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def message_count(df: DataFrame, keys: list[str] = ["c_imsi"], ts: str = "ts",
                  tie: str = "event_id", target_rows: float = TARGET_ROWS) -> DataFrame:
    """Messages of the subscriber so far, this one included."""
    return running_count(df, keys, micros(ts), tie, "f_msg_count_per_imsi", target_rows)


def add_between_lu_counts(sliced: Sliced, tie: str = "event_id") -> Sliced:
    """Operations of each kind since the last location update, this record included.

    A location update closes the stretch it ends: it is counted in it, and the next record
    starts from zero. With sliced keys, a slice hands on the counts after its last update,
    or, if it has none, its counts on top of what it received.
    """
    rows, slicing = sliced
    is_update = F.col("op").isin(LOCATION_UPDATES).cast("bigint")
    before = cell(AT, tie).rowsBetween(Window.unboundedPreceding, -1)
    staged = rows.withColumn("_part", F.coalesce(F.sum(is_update).over(before), F.lit(0)))
    stretch = (Window.partitionBy(KEY, SLICE, "_part").orderBy(AT, tie)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = {f"f_count_ok_{op}_between2lu": F.count_if(F.col("op") == op).over(stretch)
             for op in OPERATIONS}
    counted = staged.withColumns(local)
    if slicing.cuts:
        names = list(local)
        last = F.struct(is_update.alias("closed"), *names)
        ends = (heavy_only(counted, slicing).groupBy(KEY, SLICE)
                .agg(F.sum(is_update).alias("_updates"),
                     F.max_by(last, F.struct(F.col(AT), F.col(tie))).alias("_end")))
        tails = ends.select(
            KEY, SLICE, (F.col("_updates") > 0).cast("int").alias("_has"),
            *[F.when(F.col("_end.closed") == 1, 0).otherwise(F.col(f"_end.{n}")).alias(f"_t_{n}")
              for n in names])
        # Slices from one that has an update up to the next such slice add up.
        group = Window.partitionBy(KEY).orderBy(SLICE)
        grouped = tails.withColumn("_group", F.sum("_has").over(group))
        within = Window.partitionBy(KEY, "_group").orderBy(SLICE)
        open_counts = grouped.select(
            KEY, SLICE, *[F.sum(f"_t_{n}").over(within).alias(f"_o_{n}") for n in names])
        received = open_counts.select(
            KEY, SLICE, *[F.lag(f"_o_{n}").over(group).alias(f"_c_{n}") for n in names])
        counted = carry(counted, slicing, received)
        first_part = F.col("_part") == 0
        counted = counted.withColumns({
            n: F.col(n) + F.when(first_part, F.coalesce(F.col(f"_c_{n}"), F.lit(0))).otherwise(0)
            for n in names}).drop(*[f"_c_{n}" for n in names])
    return sliced.with_rows(counted.drop("_part"))


def add_gap(sliced: Sliced, ts: str = "ts", tie: str = "event_id", longest: int = 900,
            fixed_gap_nodes: list[str] = [], node: str = "c_cggt") -> Sliced:
    """Seconds since the subscriber's previous record, at most ``longest``.

    No previous record, or a node in ``fixed_gap_nodes``, gives ``longest``.
    """
    timed = sliced.with_rows(sliced.rows.withColumn("_second", seconds(ts)))
    linked = add_previous_row(timed, tie, ["_second"], "_previous").rows
    gap = F.least(F.col("_second") - F.col("_previous._second"), F.lit(longest))
    # Least of a null and a number would be the number.
    gap = F.when(F.col("_previous").isNotNull(), gap)
    if fixed_gap_nodes:
        gap = F.when(~F.coalesce(F.col(node).isin(fixed_gap_nodes), F.lit(False)), gap)
    return sliced.with_rows(
        linked.withColumn("gap_seconds", F.coalesce(gap, F.lit(longest)).cast("bigint"))
        .drop("_second", "_previous"))


def between_lu_counts(df: DataFrame, keys: list[str] = ["c_imsi"], ts: str = "ts",
                      tie: str = "event_id", target_rows: float = TARGET_ROWS) -> DataFrame:
    return add_between_lu_counts(sliced_by(df, keys, micros(ts), target_rows), tie).done()


def gap_since_previous(df: DataFrame, keys: list[str] = ["c_imsi"], ts: str = "ts",
                       tie: str = "event_id", target_rows: float = TARGET_ROWS,
                       **options) -> DataFrame:
    return add_gap(sliced_by(df, keys, micros(ts), target_rows), ts, tie, **options).done()


def sequence_features(df: DataFrame, keys: list[str] = ["c_imsi"], ts: str = "ts",
                      tie: str = "event_id", target_rows: float = TARGET_ROWS,
                      **gap_options) -> DataFrame:
    """Message count, counts and rates between updates, update gap and ratio in one shuffle."""
    sliced = sliced_by(df, keys, micros(ts), target_rows)
    sliced = add_running_count(sliced, tie, "f_msg_count_per_imsi")
    # The counts between updates sort anew, so they come last.
    sliced = add_between_lu_counts(add_gap(sliced, ts, tie, **gap_options), tie)
    return ratio_cl_psi(sai_lu_gap(between_lu_rates(sliced.done())))


def between_lu_rates(counted: DataFrame) -> DataFrame:
    """Counts divided by the gap plus one second."""
    return counted.withColumns({
        f"f_frequent_ok_{op}_between2lu":
            F.col(f"f_count_ok_{op}_between2lu") / (F.col("gap_seconds") + 1.0)
        for op in OPERATIONS})


def sai_lu_gap(counted: DataFrame) -> DataFrame:
    updates = sum((F.col(f"f_count_ok_{op}_between2lu") for op in LOCATION_UPDATES), F.lit(0))
    return counted.withColumn("f_count_gap_ok_sai_and_all_lu",
                              F.col("f_count_ok_sai_between2lu") - updates)


def ratio_cl_psi(counted: DataFrame) -> DataFrame:
    small = 1e-5
    ratio = ((F.col("f_count_ok_cl_between2lu") + small)
             / (F.col("f_count_ok_psi_between2lu") + small))
    return counted.withColumn("f_ratio_cl_psi", F.ln(ratio))


def high_activity(df: DataFrame, keys: list[str] = ["c_imsi"], ts: str = "ts",
                  window_seconds: int = 300, at_least: int = 10,
                  target_rows: float = TARGET_ROWS) -> DataFrame:
    """Flag records with ``at_least`` records of the subscriber in the closing window."""
    counted = sliding_count(df, keys, micros(ts), window_seconds * MICROS, "_recent", target_rows)
    flag = (F.col("_recent") >= at_least).cast("int")
    return counted.withColumn("f_high_activity_5min", flag).drop("_recent")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = (half_lat * half_lat
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon)
    # Least of a null and one would be one.
    return F.when(chord.isNotNull(), 2 * 6371.0 * F.asin(F.least(F.sqrt(chord), F.lit(1.0))))


def impossible_travel(updates: DataFrame, keys: list[str] = ["c_imsi"], ts: str = "ts",
                      tie: str = "event_id", limit_kmh: float = 1000.0,
                      target_rows: float = TARGET_ROWS) -> DataFrame:
    """Flag location updates further from the last one than ``limit_kmh`` allows.

    ``updates`` holds location updates only, with ``lat`` and ``lon``.
    """
    timed = updates.withColumn("_us", micros(ts))
    linked = previous_row(timed, keys, F.col("_us"), tie, ["_us", "lat", "lon"], "_last",
                          target_rows=target_rows)
    km = haversine_km(F.col("_last.lat"), F.col("_last.lon"), F.col("lat"), F.col("lon"))
    hours = (F.col("_us") - F.col("_last._us")) / (3600.0 * MICROS)
    fast = F.when(hours > 0, km > hours * limit_kmh).otherwise(km > 0)
    return (linked.withColumn("distance_km", km)
            .withColumn("f_velocity_greater_than_1000", F.coalesce(fast, F.lit(False)).cast("int"))
            .drop("_us", "_last"))


def countries_last_hours(updates: DataFrame, hours: int, country: str = "country",
                         keys: list[str] = ["c_imsi"], ts: str = "ts",
                         target_rows: float = TARGET_ROWS) -> DataFrame:
    """Distinct countries of the subscriber's location updates in the last hours."""
    return sliding_distinct(updates, keys, country, micros(ts), hours * 3600 * MICROS,
                            "f_count_unloop_country_last_x_hours_ul", target_rows)


def psi_fan_out(df: DataFrame, calling: str, called: str, window: str,
                ts: str = "ts") -> DataFrame:
    """Called nodes per calling node and window; flagged when there is more than one.

    Smallest and largest differ exactly when there are several, and both combine on the
    map side, so a busy calling node costs one partial row per task.
    """
    return (df.where("op = 'psi'")
            .groupBy(F.window(ts, window).start.alias("window_start"), calling)
            .agg(F.count("*").alias("n_psi"),
                 (F.min(called) != F.max(called)).cast("int").alias("f_one_cggt_multi_cdgt_psi")))


def with_psi_fan_out(df: DataFrame, calling: str, called: str, window: str, ts: str = "ts",
                     spread_by: str = "event_id") -> DataFrame:
    """The flag on every record; records outside any PSI window get 0."""
    name = "f_one_cggt_multi_cdgt_psi"
    flagged = psi_fan_out(df, calling, called, window, ts).where(F.col(name) == 1)
    windowed = df.withColumn("window_start", F.window(ts, window).start)
    joined = salted_join(windowed, flagged.drop("n_psi"), ["window_start", calling], spread_by)
    return joined.withColumn(name, F.coalesce(name, F.lit(0))).drop("window_start")
