"""Exact de-duplication by an extendible-hash index on shared files.

Each scanning task first folds the equal texts of a batch into one entry: the row with the
smallest id and the ids of all of them, so a text that fills a third of the table reaches the
shuffle once per batch. A directory over hash-prefix bits doubles until no bucket holds more
bytes than its capacity; only overfull buckets split. Every bucket, which is a range of keys,
has one owner task. It meets the entries in key order, chains different texts that share a
key, compares bytes, and writes postings (ids) and classes (who stays, how many) to the index.
The owner holds the chain of one key at a time and streams the rest, so a bucket that cannot
split further, being one key, stays correct and bounded in memory.

Texts are equal when they are identical after each run of the bytes 20, 09-0D (hex) became one
space. A null text counts as empty; null ids come after all others. Of rows that repeat the
smallest id with the same text one stays, the first met. No rows give no rows. Other columns
pass through under any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import stored, struct, texts_of, unused

CAPACITY = 16 << 20
#: The directory has at most two to this power slots; this also bounds what reaches the driver.
MAX_DEPTH = 20

_TO_SPACE = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b for b in range(256))
_SPACES = re.compile(rb"\x20{2,}")


def normalised(text: bytes) -> bytes:
    text = text.translate(_TO_SPACE)
    return _SPACES.sub(b" ", text) if b"  " in text else text


def _order(value):
    return (value is None, 0 if value is None else value)


def grow_directory(sizes: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """Depth of the directory, and the bucket of each of its slots.

    ``sizes`` holds the bytes below each prefix of the greatest depth allowed. A bucket is
    named by the first such prefix that it covers.
    """
    levels = [sizes]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    levels.reverse()
    deepest = len(levels) - 1
    depth, local = 0, np.zeros(1, dtype=np.int64)
    while True:
        slots = np.arange(len(local))
        prefix = slots >> (depth - local)
        held = np.zeros(len(local), dtype=np.int64)
        for level in np.unique(local):
            at = local == level
            held[at] = levels[level][prefix[at]]
        split = (held > capacity) & (local < deepest)
        if not split.any():
            return depth, prefix << (deepest - local)
        if (local[split] == depth).any():
            local, split, depth = np.repeat(local, 2), np.repeat(split, 2), depth + 1
        local[split] += 1


def _fold(id_name: str, text_name: str, names: list[str], schema: pa.Schema):
    """Entries of a batch: the row that may stay, its key and size, and all ids."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_name).to_pylist()
            groups: dict[bytes, list[int]] = {}
            for row, text in enumerate(texts_of(batch.column(text_name).cast(pa.binary()))):
                groups.setdefault(normalised(text), []).append(row)
            for rows in groups.values():
                if len(rows) > 1:
                    rows.sort(key=lambda row: _order(ids[row]))
            kept = batch.select(names).take(pa.array([r[0] for r in groups.values()], pa.int64()))
            own = [pa.array(np.array([xxhash.xxh64_intdigest(t) for t in groups], np.uint64).view(np.int64)),
                   pa.array([len(t) + 64 for t in groups], pa.int64()),
                   pa.array([[ids[row] for row in r] for r in groups.values()], schema[-1].type)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *own], schema=schema)
    return fold


def _own(id_name: str, text_name: str, fields: list[str], carry: list[str], schema: pa.Schema):
    """Chain the entries of one owner's buckets, which come in key order."""
    bucket_name, key_name, members_name = fields
    blank = len(schema) - len(carry)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, []

        def classes():
            rows = [(key[0], key[1], n, c[1], c[2], c[3], None, None) for n, c in enumerate(chain)]
            columns = [pa.array(v, schema[i].type) for i, v in enumerate(zip(*rows))]
            columns += [pa.nulls(len(rows), schema[blank + i].type) for i in range(len(carry))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            keys = zip(batch.column(bucket_name).to_pylist(), batch.column(key_name).to_pylist())
            members = batch.column(members_name).to_pylist()
            rows, finished = [], []
            for at, (now, text) in enumerate(zip(keys, texts_of(batch.column(text_name).cast(pa.binary())))):
                if now != key:
                    if chain:
                        finished.append(classes())
                    key, chain = now, []
                text = normalised(text)
                place = next((n for n, c in enumerate(chain) if c[0] == text), None)
                first = place is None
                if first:
                    place = len(chain)
                    chain.append([text, hashlib.sha256(text).hexdigest(), members[at][0], 0])
                chain[place][3] += len(members[at])
                rows.append((*now, place, chain[place][1], None, None, members[at], first))
            yield from finished
            if rows:
                columns = [pa.array(v, schema[i].type) for i, v in enumerate(zip(*rows))]
                stay = pa.array([at if row[-1] else None for at, row in enumerate(rows)], pa.int64())
                columns += [batch.column(c).take(stay).cast(schema[blank + i].type)
                            for i, c in enumerate(carry)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if chain:
            yield classes()
    return own


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep_rows: bool = False, capacity: int = CAPACITY,
                max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index as a table on shared files.

    Columns bucket, key, chain, digest; of class rows keep_id and group_size; of posting rows
    members and first (the posting whose first id stays). With ``keep_rows`` that posting also
    carries the row of ``docs`` in ``row``; its text is also what bytes are compared on, so entries
    and shuffle hold each text once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    names = docs.columns if keep_rows else [id_col, text_col]
    raw, key, size, members, bucket, slot, first = (
        unused(docs.columns, f"_{n}") for n in ("raw", "key", "size", "ids", "bucket", "slot", "first"))
    if keep_rows and isinstance(docs.schema[text_col].dataType, (T.StringType, T.BinaryType)):
        source, raw = docs.select(*names), text_col
    else:
        source = docs.select(*names, F.col(text_col).cast("binary").alias(raw))
        names = [*names, raw]
        if not keep_rows:
            source, names = source.drop(text_col), [id_col, raw]
    entry_schema = T.StructType([*source.schema.fields, *struct(
        (key, T.LongType()), (size, T.LongType()), (members, T.ArrayType(id_type))).fields])
    entries = stored(source.mapInArrow(
        _fold(id_col, raw, names, to_arrow_schema(entry_schema)), entry_schema), "entries")

    prefix = F.shiftrightunsigned(key, 64 - max_depth)
    sizes = np.zeros(1 << max_depth, dtype=np.int64)
    for row in entries.groupBy(prefix.alias("p")).agg(F.sum(size).alias("b")).toLocalIterator():
        sizes[row.p] = row.b
    depth, directory = grow_directory(sizes, capacity)
    shown = spark.createDataFrame(
        pa.table({slot: np.arange(len(directory)), bucket: directory.astype(np.int64)}))
    place = F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0)

    carry = docs.columns if keep_rows else []
    index_schema = T.StructType([*struct(
        ("bucket", T.LongType()), ("key", T.LongType()), ("chain", T.IntegerType()),
        ("digest", T.StringType()), ("keep_id", id_type), ("group_size", T.LongType()),
        ("members", T.ArrayType(id_type)), ("first", T.BooleanType())).fields,
        *[T.StructField(f"row_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]])
    owned = (entries.withColumn(slot, place.cast("long"))
             # At most 2 ** max_depth rows of two numbers.
             .join(F.broadcast(shown), slot).drop(slot)
             .withColumn(first, F.col(members)[0])
             .repartition(bucket)
             .sortWithinPartitions(bucket, key, size, F.col(first).asc_nulls_last()))
    index = owned.mapInArrow(_own(id_col, raw, [bucket, key, members], carry,
                                  to_arrow_schema(index_schema)), index_schema)
    return stored(index, "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **limits) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, **limits)
    classes = index.where("group_size IS NOT NULL").select("bucket", "key", "chain", "keep_id",
                                                           "group_size")
    postings = index.where("members IS NOT NULL").drop("keep_id", "group_size")
    return (postings.join(classes, ["bucket", "key", "chain"])
            .select(F.posexplode("members").alias("at", id_col), "keep_id", "group_size",
                    "first", F.col("digest").alias("text_sha256"))
            .select(id_col, "keep_id", "group_size", (F.col("first") & (F.col("at") == 0)).alias("kept"),
                    "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                **limits) -> DataFrame:
    """The rows of ``docs`` that stay, whole."""
    index = build_index(docs, id_col, text_col, keep_rows=True, **limits)
    return index.where("first").select(
        *[F.col(f"row_{i}").alias(c) for i, c in enumerate(docs.columns)])
