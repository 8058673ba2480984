"""Per-key ordered operators that survive heavy keys.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task, which fails
when one subscriber or source holds a large share of the data. Here the rows of heavy
keys are cut along the order axis into slices of about ``TARGET_ROWS`` rows. Window
functions run within (key, slice); what earlier slices contribute is carried in from a
table with one row per (heavy key, slice). Results are exactly those of the plain window.

Heavy keys come from exact counts, cut points from quantiles of each key's own rows. There are
never more than ``MOST_SLICES`` heavy keys or slices' worth of rows, whatever the table: beyond
that slices grow. Below ``TARGET_ROWS`` rows in total nothing can be heavy and no extra pass is
made. A target below 1 is a share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

TARGET_ROWS = 4_000_000
MOST_SLICES = 4096
#: Rows of a key beyond which a join spreads them.
SALT_ROWS = 1_000_000

KEY, AT, SLICE = "_key", "_at", "_slice"


class Slicing(NamedTuple):
    keys: list[str]
    cuts: list[float]


def key_text(*columns: str) -> Column:
    """One null-safe text key for grouping, joining and windowing alike."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    if len(parts) == 1:
        return parts[0]
    return F.concat_ws("\u0001", *parts) if parts else F.lit("")


def slice_target(target_rows: float, total: int) -> int:
    """Rows of a slice: a number, or a share of all rows, and enough of them to bound the slices."""
    wanted = ceil(target_rows * total) if target_rows < 1 else target_rows
    return max(1, int(wanted), ceil(total / MOST_SLICES))


def find_slicing(keyed: DataFrame, target_rows: float = TARGET_ROWS) -> Slicing:
    """Heavy keys of a frame with KEY and AT columns, and where to cut them."""
    total = keyed.count()
    target = slice_target(target_rows, total)
    if total <= target:  # then no key can exceed it
        return Slicing([], [])
    # Counts combine before the shuffle; at most MOST_SLICES keys are heavy.
    found = {r[KEY]: r["_rows"] for r in keyed.groupBy(KEY).agg(F.count("*").alias("_rows"))
             .where(F.col("_rows") > target).collect()}
    if not found:
        return Slicing([], [])
    # Sketches of each heavy key's own axis; a key takes every so many of the finest quantiles.
    most = ceil(max(found.values()) / target)
    ranks = F.array(*[F.lit(i / most) for i in range(1, most)])
    wanted = F.ceil(F.count("*") / F.lit(target)).cast("int").alias("_wanted")
    sketches = keyed.where(F.col(KEY).isin(list(found))).groupBy(KEY).agg(
        wanted, F.percentile_approx(F.col(AT).cast("double"), ranks, 4 * most).alias("_finest"))
    picked = sketches.select(F.explode(F.expr(
        f"transform(sequence(1, _wanted - 1), i -> element_at(_finest, CAST(i * {most} / _wanted AS INT)))")))
    return Slicing(sorted(found), sorted({r[0] for r in picked.collect() if r[0] is not None}))


def light_slicing(source: DataFrame, per_row: int, target_rows: float) -> Slicing | None:
    """No slicing when the source is small enough that rows derived from it must be too.

    Counting the source is cheaper than counting what is derived; None means undecided.
    """
    return Slicing([], []) if source.count() * per_row <= target_rows else None


def slice_rows(keyed: DataFrame, slicing: Slicing) -> DataFrame:
    """Add SLICE: 0 for light keys, the position between the cut points for heavy ones."""
    if not slicing.cuts:
        return keyed.withColumn(SLICE, F.lit(0))
    number = F.coalesce(F.col(AT).cast("double"), F.lit(-1e300))
    cutter = Bucketizer(splits=[float("-inf"), *slicing.cuts, float("inf")],
                        inputCol="_axis", outputCol="_piece")
    piece = F.when(F.col(KEY).isin(slicing.keys), F.col("_piece").cast("int")).otherwise(0)
    return (cutter.transform(keyed.withColumn("_axis", number))
            .withColumn(SLICE, piece).drop("_axis", "_piece"))


def heavy_only(sliced: DataFrame, slicing: Slicing) -> DataFrame:
    return sliced.where(F.col(KEY).isin(slicing.keys))


def cell(*order: Column | str) -> Window:
    return Window.partitionBy(KEY, SLICE).orderBy(*order)


def earlier_slices() -> Window:
    """All slices of the key before this one; one row per slice."""
    return (Window.partitionBy(KEY).orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1))


def carry(sliced: DataFrame, slicing: Slicing, summary: DataFrame) -> DataFrame:
    """Join per-slice carry-in values; both sides are partitioned by (key, slice)."""
    return sliced.join(summary, [KEY, SLICE], "left") if slicing.cuts else sliced


def keyed_rows(df: DataFrame, keys: list[str], at: Column) -> DataFrame:
    return df.withColumn(KEY, key_text(*keys)).withColumn(AT, at)


class Sliced(NamedTuple):
    """Rows with KEY, AT and SLICE; all steps below share one shuffle on (KEY, SLICE)."""

    rows: DataFrame
    slicing: Slicing

    def with_rows(self, rows: DataFrame) -> "Sliced":
        return Sliced(rows, self.slicing)

    def done(self) -> DataFrame:
        return self.rows.drop(KEY, AT, SLICE)


def sliced_by(df: DataFrame, keys: list[str], at: Column, target_rows: float = TARGET_ROWS,
              slicing: Slicing | None = None) -> Sliced:
    """Key the rows and cut heavy keys; a known ``slicing`` saves the pass that finds them."""
    keyed = keyed_rows(df, keys, at)
    if slicing is None:
        slicing = find_slicing(keyed.select(KEY, AT), target_rows)
    return Sliced(slice_rows(keyed, slicing), slicing)


def add_running_count(sliced: Sliced, tie: str, name: str) -> Sliced:
    """1-based position of each row among the rows of its key, ordered by (at, tie)."""
    rows, slicing = sliced
    position = F.row_number().over(cell(AT, tie)).cast("bigint")
    if slicing.cuts:
        before = (heavy_only(rows, slicing).groupBy(KEY, SLICE).agg(F.count("*").alias("_n"))
                  .select(KEY, SLICE, F.sum("_n").over(earlier_slices()).alias("_before")))
        rows = carry(rows, slicing, before)
        position = position + F.coalesce(F.col("_before"), F.lit(0))
    return sliced.with_rows(rows.withColumn(name, position).drop("_before"))


def add_running_sums(sliced: Sliced, values: Mapping[str, Column]) -> Sliced:
    """Cumulative sums per key over all rows with an equal or smaller AT."""
    rows, slicing = sliced
    rows = rows.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    if slicing.cuts:
        per_slice = (heavy_only(rows, slicing).groupBy(KEY, SLICE)
                     .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values]))
        before = per_slice.select(
            KEY, SLICE, *[F.sum(f"_s_{n}").over(earlier_slices()).alias(f"_b_{n}") for n in values])
        rows = carry(rows, slicing, before)
    upto = cell(AT).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {}
    for n in values:
        total = F.sum(f"_v_{n}").over(upto)
        sums[n] = total + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) if slicing.cuts else total
    helpers = [f"_{kind}_{n}" for kind in ("v", "b") for n in values]
    return sliced.with_rows(rows.withColumns(sums).drop(*helpers))


def add_previous_row(sliced: Sliced, tie: str, fields: list[str], name: str,
                     only: Column | None = None) -> Sliced:
    """Struct of ``fields`` from the nearest earlier row of the key that meets ``only``."""
    rows, slicing = sliced
    row = F.struct(*fields)
    seen = row if only is None else F.when(only, row)
    earlier = cell(AT, tie).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(seen, ignorenulls=True).over(earlier)
    if slicing.cuts:
        # Slices without a candidate get a null and still take part in the carry.
        last = F.max(F.when(F.lit(True) if only is None else only,
                            F.struct(F.col(AT), F.col(tie), row.alias("row"))))
        latest = heavy_only(rows, slicing).groupBy(KEY, SLICE).agg(last.alias("_latest"))
        before = latest.select(KEY, SLICE, F.last("_latest", ignorenulls=True)
                               .over(earlier_slices()).alias("_before"))
        rows = carry(rows, slicing, before)
        found = F.coalesce(found, F.col("_before.row"))
    return sliced.with_rows(rows.withColumn(name, found).drop("_before"))


def running_count(df: DataFrame, keys: list[str], at: Column, tie: str, name: str,
                  target_rows: float = TARGET_ROWS) -> DataFrame:
    return add_running_count(sliced_by(df, keys, at, target_rows), tie, name).done()


def running_sums(df: DataFrame, keys: list[str], at: Column, values: Mapping[str, Column],
                 target_rows: float = TARGET_ROWS, slicing: Slicing | None = None) -> DataFrame:
    return add_running_sums(sliced_by(df, keys, at, target_rows, slicing), values).done()


def previous_row(df: DataFrame, keys: list[str], at: Column, tie: str, fields: list[str],
                 name: str, only: Column | None = None,
                 target_rows: float = TARGET_ROWS) -> DataFrame:
    return add_previous_row(sliced_by(df, keys, at, target_rows), tie, fields, name, only).done()


def sliding_count(df: DataFrame, keys: list[str], at: Column, width: int, name: str,
                  target_rows: float = TARGET_ROWS) -> DataFrame:
    """Rows of the key with ``at`` in [this row's at - width, this row's at].

    Each row enters at ``at`` and leaves just after ``at + width``; a running sum over
    both kinds of moment costs one sort, where a sliding frame costs rows x frame size.
    """
    moments = (df.withColumn(AT, at)
               .withColumn("_move", F.explode(F.array(
                   F.struct(F.col(AT).alias("when"), F.lit(1).alias("step"),
                            F.struct(*df.columns).alias("row")),
                   F.struct((F.col(AT) + width + 1).alias("when"), F.lit(-1).alias("step"),
                            F.lit(None).cast(df.schema).alias("row")))))
               .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_move.*"))
    counted = running_sums(moments, [f"_k{i}" for i in range(len(keys))], F.col("when"),
                           {"_count": F.col("step").cast("bigint")}, target_rows,
                           light_slicing(df, 2, target_rows))
    return counted.where(F.col("step") == 1).select("row.*", F.col("_count").alias(name))


def sliding_distinct(df: DataFrame, keys: list[str], item: str, at: Column, width: int,
                     name: str, target_rows: float = TARGET_ROWS) -> DataFrame:
    """Distinct ``item`` values of the key with ``at`` in [this row's at - width, this row's at].

    An item counts while its own sliding count is above zero, so only its changes between
    zero and not zero move the key's total.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.withColumn(AT, at)
    own = [F.col(k).alias(n) for k, n in zip(keys, names)]
    moves = (base.where(F.col(item).isNotNull())
             .select(*own, F.col(item).alias("_item"),
                     F.explode(F.array(
                         F.struct(F.col(AT).alias("when"), F.lit(1).cast("bigint").alias("step")),
                         F.struct((F.col(AT) + width + 1).alias("when"),
                                  F.lit(-1).cast("bigint").alias("step")))).alias("_m"))
             .select(*names, "_item", "_m.*")
             .groupBy(*names, "_item", "when").agg(F.sum("step").alias("step")))
    light = light_slicing(df, 3, target_rows)
    active = running_sums(moves, names + ["_item"], F.col("when"), {"_n": F.col("step")},
                          target_rows, light)
    changes = (active.select(
        *names, "when",
        ((F.col("_n") > 0).cast("bigint") - (F.col("_n") - F.col("step") > 0).cast("bigint"))
        .alias("change")).where("change <> 0"))
    empty = F.lit(None).cast(df.schema).alias("row")
    rows = base.select(*own, F.col(AT).alias("when"), F.lit(0).cast("bigint").alias("change"),
                       F.struct(*df.columns).alias("row"))
    both = rows.unionByName(changes.select("*", empty))
    counted = running_sums(both, names, F.col("when"), {"_count": F.col("change")}, target_rows, light)
    return counted.where(F.col("row").isNotNull()).select("row.*", F.col("_count").alias(name))


def heavy_join_keys(rows: DataFrame, on: list[str], target_rows: float) -> list[str]:
    """Key texts with more rows than the target, from exact counts; the ``MOST_SLICES`` heaviest at
    most, so others then have less than one in ``MOST_SLICES`` of the rows."""
    counts = rows.groupBy(key_text(*on).alias(KEY)).agg(F.count("*").alias("_rows"))
    return [r[KEY] for r in counts.where(F.col("_rows") > target_rows)
            .orderBy(F.desc("_rows")).limit(MOST_SLICES).collect()]


def salted_join(rows: DataFrame, lookup: DataFrame, on: list[str], spread_by: str,
                how: str = "left", condition: Column | None = None,
                salts: int | None = None, target_rows: float = SALT_ROWS) -> DataFrame:
    """Join that spreads the rows of each heavy key over ``salts`` tasks by copying that key's
    lookup rows. All other lookup rows go to one place, so what is shuffled grows with both sides.

    For lookup tables of unknown size, where one key may hold a large share of the rows.
    By default there are as many salts as shuffle partitions, up to 256; what is still too
    large for a task then, adaptive execution splits. ``condition`` refers to columns of
    either side that carry different names.
    """
    if salts is None:
        salts = min(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_join_keys(rows, on, target_rows)
    keys = on
    if heavy:
        salt = F.when(key_text(*on).isin(heavy), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)
        # Compared as the rows' type, in which equal keys have equal texts.
        same = lookup.select("*", *[F.col(c).try_cast(rows.schema[c].dataType).alias(f"_k_{c}") for c in on])
        copies = F.when(key_text(*[f"_k_{c}" for c in on]).isin(heavy),
                        F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        lookup = same.withColumn("_salt", F.explode(copies)).drop(*[f"_k_{c}" for c in on])
        rows, keys = rows.withColumn("_salt", salt), [*on, "_salt"]
    right = lookup.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    tests = [F.col(c) == F.col(f"_r_{c}") for c in keys]
    if condition is not None:
        tests.append(condition)
    return rows.join(right, tests, how).drop("_salt", *[f"_r_{c}" for c in keys])


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether the frame has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows
