"""Cleaning a training corpus: five stages over ``documents``, each written and reread.

Toxic documents go; of equal texts one stays; of near copies one stays; secrets are replaced in
the texts that hold them (and ``n_chars`` follows); what is left is packed into windows. Every
stage but the last returns whole rows of ``documents``. Null and empty texts are clean; they
count as equal to each other, so one stays. Very long texts pass every stage whole; rows that share
an id but not a text are separate documents. Tables without rows pass through empty.

Texts are long, so the stages hand at most ``BATCH_ROWS`` rows at a time to Python workers (the
session's setting for Arrow batches, unless that is smaller); this bounds a worker's memory. A
stage's working folders go when the next stage starts: by then its result has been written.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from sigwatch.llm import credentials, exact, packing, simhash, toxicity
from sigwatch.session import drop_folders, recorded, shared_dir

BATCH_ROWS = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Working folders of the stage before.
_left: list[str] = []


def _stage(function, last: bool = False):
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_folders(spark, _left)
        _left.clear()
        _small_batches(spark)
        with recorded() as made:
            found = function(spark, docs, sf_dir)
        if not last:  # the last result may be read from them at any time
            _left.extend(made)
        return found
    return run_stage


def _small_batches(spark: SparkSession) -> None:
    rows = int(spark.conf.get(_BATCHES))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCHES, BATCH_ROWS)


@_stage
def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


@_stage
def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


@_stage
def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return credentials.redact(docs)


@functools.partial(_stage, last=True)
def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("exact_dedup", _exact), ("near_dedup", _near),
          ("secrets", _secrets), ("packing", _packing)]

#: Scores, SimHash bits and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
