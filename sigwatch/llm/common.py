"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sigwatch.session import shared_dir


_HELD: dict = {}


def held(key, make):
    """What a worker keeps between tasks, such as a tokenizer and its memory. It keeps one such
    object at a time, so that operators that follow each other don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what earlier operators held, back to the system where Arrow kept it."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than a read of the written files."""
    spark = frame.sparkSession
    path = shared_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so (column names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a binary column; null counts as empty."""
    return [value or b"" for value in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of many slices, one slice after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
