"""How five quality filters interact, over all orders in which they can be applied.

A document counts only by its mask, the set of filters it fails, so documents are first summed to
(part, mask). Orders of the filters are ranked lexicographically by their Lehmer codes; all orders
that begin alike are an interval of ranks. What a mask contributes at a step (removed, failed but
removed earlier, still kept) depends on the beginning up to that step alone, so it covers a few
intervals per step. Those go into difference arrays: plus at an interval's first rank, minus
behind its last. A part's counts by mask, times the masks' difference arrays, summed up along the
120 ranks, give its report; parts are handled some at a time and never meet.

Filters, on the whole text: A fewer than 50 words; B 100 * distinct words < 65 * words; C 100 *
letters A to Z > 5 * code points; D any of # $ % & * |; E a row with a smaller id has the very same
text (texts are told apart by SHA-256). Words are maximal runs without the bytes 20, 09-0D (hex).

Null texts count as empty, null parts as the empty string. A row with a null id never comes
before another and has none before it. Rows that repeat an id and a text don't precede each
other. Labels of one document count as set if any of them is. Very long texts are judged whole.
Columns of other names, and of labels under clashing ones, are not read. No rows give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import struct

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts reported together.
_TOGETHER = 64


def rank(order: tuple[int, ...], size: int = len(FILTERS)) -> int:
    """Lexicographic rank of the first order that begins so, by its Lehmer code."""
    left, found = list(range(size)), 0
    for at, filter_ in enumerate(order):
        found += left.index(filter_) * math.factorial(size - 1 - at)
        left.remove(filter_)
    return found


def intervals(size: int = len(FILTERS)) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """Step (from 0), first rank, rank behind the last, and beginning of the orders there."""
    for step in range(size):
        for begin in itertools.permutations(range(size), step + 1):
            first = rank(begin, size)
            yield step, first, first + math.factorial(size - 1 - step), begin


def difference_arrays(size: int = len(FILTERS)) -> dict[str, np.ndarray]:
    """For kept, removed, redundant and unique_fails: mask by step by rank (one behind the last
    included), to be summed along ranks."""
    shape = (1 << size, size, math.factorial(size) + 1)
    arrays = {name: np.zeros(shape, np.int64) for name in MEASURES[:4]}

    def cover(name, mask, step, first, behind):
        arrays[name][mask, step, first] += 1
        arrays[name][mask, step, behind] -= 1

    for step, first, behind, begin in intervals(size):
        for mask in range(1 << size):
            earlier = any(mask >> f & 1 for f in begin[:-1])
            fails = mask >> begin[-1] & 1
            if not earlier:
                cover("removed" if fails else "kept", mask, step, first, behind)
            elif fails:
                cover("redundant", mask, step, first, behind)
            if mask == 1 << begin[-1]:
                cover("unique_fails", mask, step, first, behind)
    return arrays


def failures(text: Column) -> list[Column]:
    """Filters A to D as 0 or 1."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return [F.size(words) < 50,
            F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(65).cast("long"),
            F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"),
            text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Part, mask, n, good, toxic: documents by the filters they fail (bit 0 is A)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    judged = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"),
                         sum(fails.cast("int") * (1 << bit) for bit, fails in enumerate(failures(text))).alias("mask"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    by_id = (judged.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
             .join(marks, "id", "left").fillna(0, ["good", "toxic"]))
    # Of equal texts only the rows with the smallest id pass E, and all copies share the other
    # filters; so copies are summed before they meet, by at most (parts x labels) rows.
    alike = by_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    least = alike.groupBy("digest").agg(F.min("first.id").alias("least"))
    split = alike.join(least, "digest")
    passes = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    each = split.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), passes.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passes).alias("n")))))
    return (each.where("n > 0").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                 F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


_REPORT = struct(("part", T.StringType()), ("filter_order", T.StringType()), ("step", T.IntegerType()),
                 *[(name, T.LongType()) for name in (*MEASURES, "shapley")])


def _report(schema: pa.Schema):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = difference_arrays()
        size, orders = len(FILTERS), list(itertools.permutations(range(len(FILTERS))))
        names = pa.array([n for o in orders for n in ["".join(FILTERS[f] for f in o)] * size])
        steps = pa.array(list(range(1, size + 1)) * len(orders), pa.int32())
        at_filter = [np.array([[o[step] == f for step in range(size)] for o in orders]) for f in range(size)]
        for batch in batches:
            parts = batch.column(0)
            counts = {}
            for column, name in zip(batch.columns[1:], ("n", "good", "toxic")):
                counts[name] = np.array(column.to_pylist(), np.int64).reshape(len(parts), 1 << size)
            for start in range(0, len(parts), _TOGETHER):
                some = slice(start, start + _TOGETHER)
                width = len(parts[some])

                def totals(measure, name="n"):
                    ends = np.tensordot(counts[name][some], arrays[measure], axes=1)
                    return np.cumsum(ends, axis=2)[:, :, :-1].transpose(0, 2, 1)
                found = [totals(m) for m in MEASURES[:4]] + [totals("removed", "good"), totals("removed", "toxic")]
                shapley = np.zeros_like(found[0])
                for place in at_filter:
                    shapley += np.where(place, (found[1] * place).sum(axis=(1, 2), keepdims=True), 0)
                for row in range(width):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([parts[start + row].as_py()] * len(names)), names, steps,
                         *(pa.array(values[row].ravel()) for values in (*found, shapley))], schema=schema)
    return report


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step, with its counts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def by_mask(name):
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0))
                         for m in range(1 << len(FILTERS))]).alias(name)
    counts = masks(docs, labels, part_col, id_col, text_col)
    return counts.groupBy("part").agg(*map(by_mask, ("n", "good", "toxic"))).mapInArrow(
        _report(to_arrow_schema(_REPORT)), _REPORT)
