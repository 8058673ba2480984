"""Validation, cleaning, de-duplication and profiling."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql import types as T

from sigwatch.functions.checks import to_number, valid_imsi, valid_timestamp


#: Where a line stands: its file, the start of the block read by one task, and the order within it.
FILE_ORDER = ["_file", "_block", "_line"]


class MissingColumns(ValueError):
    """Input lacks columns the job needs."""


class SingleClass(ValueError):
    """The target holds fewer than two classes."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def with_prefix(df: DataFrame, prefix: str = "f_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fixed columns in fixed order; absent ones become null."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def validity(df: DataFrame, imsi: str | None = "c_imsi", imsi_length: int = 15,
             timestamp: str | None = "c_timestamp", time_format: str | None = None) -> Column:
    """Both checks together; a check whose column is absent passes."""
    tests = [F.lit(True)]
    if imsi in df.columns:
        tests.append(valid_imsi(F.col(imsi), imsi_length))
    if timestamp in df.columns:
        tests.append(valid_timestamp(F.col(timestamp), time_format))
    return reduce(and_, tests)


def validate(df: DataFrame, remove_invalid: bool = True, observe: Observation | None = None,
             **columns) -> DataFrame:
    """Drop invalid rows; the counts come from the same pass through ``observe``."""
    marked = df.withColumn("_valid", validity(df, **columns))
    if observe is not None:
        marked = marked.observe(observe, F.count("*").alias("rows_in"),
                                F.count_if("_valid").alias("rows_valid"),
                                F.count_if(~F.col("_valid")).alias("rows_invalid"))
    return (marked.where("_valid") if remove_invalid else marked).drop("_valid")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def first_of_each(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """Earliest row of each ``subset`` value.

    A minimum over (order, other columns) combines on the map side, so a value with very
    many copies reaches the shuffle once per map task.
    """
    rest = [c for c in df.columns if c not in subset and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    picked = df.groupBy(*subset).agg(first).select(*subset, "_first.*")
    return picked.select(*df.columns)


def clean(df: DataFrame, required: list[str], remove_invalid: bool = True,
          remove_duplicates: bool = True, duplicate_subset: list[str] | None = None,
          order: list[str] | None = None, observe: Observation | None = None,
          **columns) -> DataFrame:
    """Whole cleaning job: required columns, validity, duplicates.

    Of rows alike in ``duplicate_subset`` the first by ``order`` stays, without one the first in
    the files, which must then have been read with their ``FILE_ORDER``. The file order is
    dropped, and whole rows that repeat are compared without it.
    """
    require_columns(df, required)
    in_files = all(c in df.columns for c in FILE_ORDER)
    order = order or (FILE_ORDER if in_files else None)
    if remove_duplicates and duplicate_subset and not order:
        raise ValueError("the first of duplicates needs an order: name one, or read files with file_order")
    kept = validate(df, remove_invalid, observe, **columns)
    if remove_duplicates and duplicate_subset:
        kept = first_of_each(kept, duplicate_subset, order)
    kept = kept.drop(*FILE_ORDER) if in_files else kept
    return distinct_rows(kept) if remove_duplicates and not duplicate_subset else kept


def validation_report(df: DataFrame, **columns) -> DataFrame:
    """One row: rows in, valid, invalid, duplicates among the valid, rows out."""
    valid = validity(df, **columns)
    alike = (df.withColumn("_valid", valid).groupBy("_valid", *df.columns)
             .agg(F.count("*").alias("_copies")))
    copies, ok = F.col("_copies"), F.col("_valid")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return alike.agg(
        total(copies).alias("rows_in"),
        total(F.when(ok, copies)).alias("rows_valid"),
        total(F.when(~ok, copies)).alias("rows_invalid"),
        total(F.when(ok, copies - 1)).alias("duplicates"),
        F.count_if(ok).alias("rows_out"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, all columns in one pass."""
    counts = df.agg(F.count("*").alias("_rows"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"),
                               F.col("_rows").alias("total_rows")) for c in df.columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def fit_imputer(df: DataFrame, columns: list[str]) -> ImputerModel:
    """Column means, to be fitted on training rows and applied anywhere."""
    return Imputer(strategy="mean", inputCols=columns, outputCols=columns).fit(df)


def clean_target(df: DataFrame, target: str = "label", *, check: bool = True) -> DataFrame:
    """Numeric target without nulls, as integer; one class only is an error."""
    number = to_number(F.col(target))
    cleaned = (df.withColumn(target, number).where(F.col(target).isNotNull())
               .withColumn(target, F.col(target).cast("int")))
    if check:
        low, high = cleaned.agg(F.min(target), F.max(target)).first()
        if low is None or low == high:
            raise SingleClass(f"column {target} holds one class only: {low}")
    return cleaned


def unexpected_targets(df: DataFrame, target: str = "label") -> DataFrame:
    """Target values outside 0 and 1 with their counts."""
    return df.groupBy(target).count().where(~F.col(target).isin(0, 1))


def class_counts(df: DataFrame, target: str = "label") -> DataFrame:
    return df.groupBy(target).agg(F.count("*").alias("n"))


def class_weight(df: DataFrame, target: str = "label") -> DataFrame:
    """Negatives per positive; 1.0 when either class is missing or others occur."""
    ones, zeros = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    counts = df.agg(zeros.alias("n0"), ones.alias("n1"), F.max(target).alias("_top"))
    usable = (F.col("n1") > 0) & (F.col("_top") == 1)
    return counts.select("n0", "n1", F.coalesce(
        F.when(usable, F.col("n0").cast("double") / F.col("n1")), F.lit(1.0)).alias("pos_weight"))


def dataset_summary(df: DataFrame, target: str = "label") -> DataFrame:
    return df.agg(F.count("*").alias("num_samples"), F.avg(target).alias("fraud_ratio"))
