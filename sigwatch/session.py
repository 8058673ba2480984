"""Session settings shared by batch jobs, streams and tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times carry no zone, so the session must read them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="sigwatch-")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)
    return path


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that :func:`shared_dir` names meanwhile."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not made]


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, where they exist."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back, which ends its lineage there."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
