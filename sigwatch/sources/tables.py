"""CSV and JSON-lines sources, and the file sinks that mirror them."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from sigwatch.operators.quality import FILE_ORDER, MissingColumns
from sigwatch.schemas import IDS_EVENTS

_HEAD_CHARS = 5 * 1024


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter from the head of the data; a comma when it cannot be told."""
    head = "\n".join(r[0] for r in spark.read.text(path)
                     .select(F.substring("value", 1, _HEAD_CHARS)).limit(50).collect())[:_HEAD_CHARS]
    try:
        return csv.Sniffer().sniff(head).delimiter if head else ","
    except csv.Error:
        return ","


def not_utf8_files(spark: SparkSession, path: str) -> list[str]:
    """Files with any line that is no valid UTF-8; lines are checked where they are read."""
    bad = (spark.read.text(path).where(~F.is_valid_utf8("value"))
           .select(F.col("_metadata.file_path").alias("file")).distinct())
    return sorted(r["file"] for r in bad.toLocalIterator())


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def by_name(frame: DataFrame, names: list[str], schema: T.StructType,
            required: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Text columns called as in a header, as the declared columns; absent ones are null."""
    missing = [c for c in required if c not in names]
    if missing:
        raise MissingColumns(", ".join(missing))
    return frame.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema], *keep)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
             detect_encoding: bool = False, source_column: str | None = None,
             required: Sequence[str] = (), file_order: bool = False, **options) -> DataFrame:
    """CSV columns by the names in the header, cast to the declared types.

    Declared columns that the header lacks are null, or an error if ``required`` names them;
    values that do not fit their type are null. No files or empty files give no rows. All files
    of a path share one header; a file with another one is an error, not a mix-up.

    With ``detect_encoding``, files that are not UTF-8 are read as Latin-1. With ``file_order``, the
    columns ``FILE_ORDER`` tell where each line stands: files by name, then lines as they follow.
    """
    def read(where: str | list[str], encoding: str) -> DataFrame:
        reader = (spark.read.option("header", True).option("sep", sep)
                  .option("encoding", encoding).options(**options))
        names = reader.csv(where).columns
        if not names:
            raise AnalysisException("PATH_NOT_FOUND: no header")
        frame = reader.schema(text_schema(names)).option("enforceSchema", False).csv(where)
        source = [F.col("_metadata.file_name").alias(source_column)] if source_column else []
        if file_order:
            # A block of a file is read by one task from its first line to its last.
            source += [F.col("_metadata.file_path").alias(FILE_ORDER[0]),
                       F.col("_metadata.file_block_start").alias(FILE_ORDER[1]),
                       F.monotonically_increasing_id().alias(FILE_ORDER[2])]
        return by_name(frame, names, schema, required, source)

    try:
        if not detect_encoding:
            return read(path, "UTF-8")
        latin = not_utf8_files(spark, path)
        if not latin:
            return read(path, "UTF-8")
        every = [r[0] for r in spark.read.format("binaryFile").load(path).select("path")
                 .toLocalIterator()]
        # Both listings name files as URIs, which may differ in their leading slashes.
        tail = {f.split(":", 1)[-1].lstrip("/") for f in latin}
        utf8 = [f for f in every if f.split(":", 1)[-1].lstrip("/") not in tail]
        old = read(latin, "ISO-8859-1")
        return read(utf8, "UTF-8").unionByName(old) if utf8 else old
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        more = [T.StructField(source_column, T.StringType())] if source_column else []
        if file_order:
            more += [T.StructField(c, kind) for c, kind in zip(FILE_ORDER, (T.StringType(), T.LongType(), T.LongType()))]
        return spark.createDataFrame([], T.StructType([*schema.fields, *more]))


def parse_ids_events(lines: DataFrame, column: str = "value", keep_bad: bool = False) -> DataFrame:
    """IDS events from JSON texts; malformed ones are left out, or only they are kept."""
    schema = T.StructType([*IDS_EVENTS.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    texts = lines.where(F.length(F.trim(column)) > 0)
    parsed = texts.withColumn("_event", F.from_json(column, schema, options))
    if keep_bad:
        return parsed.where(F.col("_event._bad").isNotNull()).drop("_event")
    good = F.col("_event").isNotNull() & F.col("_event._bad").isNull()
    return parsed.where(good).select("_event.*").drop("_bad")


def read_ids_events(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """IDS events from files of JSON lines."""
    return parse_ids_events(spark.read.text(path), keep_bad=keep_bad)


def write_features(df: DataFrame, path: str, batch_date: str) -> None:
    """Labelled features as Parquet, one folder per batch date."""
    (df.withColumn("batch_date", F.lit(batch_date)).write.mode("append")
     .partitionBy("batch_date").parquet(path))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_messages(payloads: DataFrame, path: str) -> None:
    """Outgoing messages (one JSON text per row) as files, when no broker is at hand."""
    payloads.select("value").write.mode("append").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Dataset summary with its time, as one JSON line."""
    (summary.withColumn("generated_at", F.date_format(F.current_timestamp(),
                                                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
     .coalesce(1).write.mode("overwrite").json(path))
