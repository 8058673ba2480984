"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of each text; a chunk ends where the hash is the highest among
its neighbours on both sides. Such a place depends on the bytes around it alone, so chunks
resist insertions and need no pass from the start of the text. Chunks have at least as many
bytes as the neighbourhood. Periodic text has no single highest place, but one in every period:
there a chunk ends at each that lies a neighbourhood or more behind the last end, so that all
chunks of the run start at the same phase and are equal wherever the run stands. What has neither
is cut at the greatest length. Chunks are grouped by a 128-bit digest: one aggregation with map-side combine
counts them and finds the smallest document, so a line that everyone repeats costs one row per
task; the join back sends only what repeats and splits skewed digests.

Adjacent repeated chunks of a document form a span, reported if it has at least ``min_words``
words. Chunks at the edges of a passage reach beyond it and stay out, so a span is up to some
ten words shorter at either end than the passage. A chunk's first occurrence is the first one
in the document with the smallest id; ``drop_repeats`` removes all others within spans.

Null and empty texts have no chunks. Repeated rows repeat each other's text, so they appear.
Null ids take part and are never first unless all are null. Rows are told apart by themselves, not
by their ids, so that rows with equal or null ids are each cut by their own spans. Very long texts
are chunked whole. Other columns pass through ``drop_repeats`` under any name. No rows give no
spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import stored, struct, texts_of, unused

REACH, LONGEST, MIN_WORDS = 24, 256, 20
_ROLLED = 16
#: Byte values as 16 random bits, from a fixed rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_WORD_BITS = 12


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; a 16-bit sum of shifted values, rolled by doubling."""
    hashes, span = GEAR[data], 1
    while span < _ROLLED:
        wider = hashes.copy()
        wider[span:] += hashes[:-span] << np.uint16(span)
        hashes, span = wider, 2 * span
    return hashes


def _ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The highest of the ``width`` values from each place on."""
    best, span = values.copy(), 1
    while 2 * span <= width:
        best[:-span] = np.maximum(best[:-span], best[span:])
        span *= 2
    if span < width:
        rest = width - span
        best[:-rest] = np.maximum(best[:-rest], best[rest:])
    return best


def _with_equals(ends: np.ndarray, equal: np.ndarray, reach: int) -> np.ndarray:
    """Add the places as high as a neighbour that lie ``reach`` or more behind the last end."""
    before = np.searchsorted(ends, equal)
    latest = np.where(before > 0, ends[before - 1] if len(ends) else 0, -reach).tolist()
    added, last = [], -reach
    for at, end in zip(equal.tolist(), latest):
        last = max(last, end)
        if at - last >= reach:
            added.append(at)
            last = at
    return np.sort(np.concatenate([ends, np.array(added, np.int64)]))


def chunk_ends(data: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Where chunks end, as byte offsets; never inside a character."""
    size = len(data)
    if not size:
        return np.empty(0, np.int64)
    ends = np.empty(0, np.int64)
    if size > reach + 1:
        hashes = gear_hashes(data).astype(np.int32)
        after, before = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        after[:-1] = _ahead(hashes, reach)[1:]
        before[1:] = _ahead(hashes[::-1], reach)[::-1][:-1]
        highest = (hashes >= before) & (hashes >= after)
        alone = hashes > before
        ends = np.flatnonzero(highest & alone) + 1
        equal = np.flatnonzero(highest & ~alone) + 1
        if len(equal):
            ends = _with_equals(ends, equal, reach)
    edges = np.concatenate([[0], ends[ends < size], [size]])
    if (np.diff(edges) > longest).any():
        edges = np.concatenate([np.arange(a, b, longest) for a, b in zip(edges, edges[1:])] + [[size]])
    ends = edges[1:].astype(np.int64)
    for _ in range(3):  # a character has at most three further bytes
        inner = ends < size
        inner[inner] = (data[ends[inner]] & 0xC0) == 0x80
        ends[inner] += 1
    return np.unique(ends)


_CHUNK = [("doc_row", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("start", T.LongType()),
          ("meta", T.LongType())]


def _chunk(schema: pa.Schema, reach: int, longest: int):
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            found = [[], [], []]
            source = []
            for at, text in enumerate(texts_of(batch.column(2))):
                data = np.frombuffer(text, np.uint8)
                ends = chunk_ends(data, reach, longest)
                if not len(ends):
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                space = _SPACE[data]
                heads = ~space
                heads[1:] &= space[:-1]
                words = np.add.reduceat(heads, starts, dtype=np.int64)
                points = np.cumsum((data & 0xC0) != 0x80)
                begin = np.concatenate([[0], points[ends[:-1] - 1]])
                length = points[ends - 1] - begin
                digests = [digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                seen: set[bytes] = set()
                again = np.array([d in seen or seen.add(d) is not None for d in digests])
                found[0].append(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2))
                found[1].append(begin)
                found[2].append((length << (_WORD_BITS + 1)) | (words << 1) | again)
                source.append(np.full(len(ends), at))
            if source:
                both, owner = np.concatenate(found[0]), pa.array(np.concatenate(source))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner),
                     *(pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)),
                     pa.array(np.concatenate(found[1]).astype(np.int64)), pa.array(np.concatenate(found[2]))],
                    schema=schema)
    return chunk


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH,
            longest: int = LONGEST, row_col: str | None = None) -> DataFrame:
    """The chunks of all texts, stored; ``doc_row`` is column ``row_col`` or a number of the row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    if longest >= 1 << _WORD_BITS:
        raise ValueError("a chunk this long may have too many words")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *struct(*_CHUNK).fields])
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()  # holds once stored
    return stored(docs.select(F.col(id_col).alias("doc_id"), row.alias("doc_row"), F.col(text_col).cast("binary").alias("raw"))
                  .mapInArrow(_chunk(to_arrow_schema(schema), reach, longest), schema), "chunks")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, reach: int = REACH, longest: int = LONGEST) -> DataFrame:
    """Spans of repeated text: doc_id, start, end (code points), words, chunks, first_doc_id (the
    smallest document that shares a chunk), kept_words (in chunks that occur here first), and
    ``repeats``, the ranges that occur earlier elsewhere."""
    return _row_spans(docs, id_col, text_col, min_words, reach, longest).drop("doc_row")


def _row_spans(docs, id_col, text_col, min_words=MIN_WORDS, reach=REACH, longest=LONGEST, row_col=None) -> DataFrame:
    chunks = chunked(docs, id_col, text_col, reach, longest, row_col)
    repeated = (chunks.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id"))
                .where("n > 1").select("d1", "d2", "first_doc_id"))
    words = F.expr(f"shiftright(meta, 1) & {(1 << _WORD_BITS) - 1}")
    found = chunks.join(repeated, ["d1", "d2"]).select(
        "doc_id", "doc_row", "start", (F.col("start") + F.shiftright("meta", _WORD_BITS + 1)).alias("end"),
        words.alias("words"), "first_doc_id",
        (F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.expr("meta & 1") == 0)).alias("first"))
    in_order = Window.partitionBy("doc_row").orderBy("start")
    opens = F.coalesce((F.lag("end").over(in_order) != F.col("start")).cast("int"), F.lit(1))
    spans = (found.withColumn("opens", opens).withColumn("span", F.sum("opens").over(in_order))
             .groupBy("doc_row", "span").agg(
                 F.first("doc_id").alias(id_col), F.min("start").alias("start"), F.max("end").alias("end"),
                 F.sum("words").alias("words"), F.count("*").alias("chunks"),
                 F.min("first_doc_id").alias("first_doc_id"),
                 F.sum(F.when(F.col("first"), F.col("words")).otherwise(0)).alias("kept_words"),
                 # At most the chunks of one text.
                 F.collect_list(F.when(~F.col("first"), F.struct("start", "end"))).alias("repeats")))
    return spans.where(F.col("words") >= min_words).drop("span")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with repeats cut out of their texts, row by row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    row = unused(docs.columns, "row")
    cut = unused([*docs.columns, row], "cut")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ranges = (_row_spans(kept, id_col, text_col, row_col=row, **limits)
              .select(F.col("doc_row").alias(row), F.explode("repeats").alias("r"))
              .groupBy(row).agg(F.sort_array(F.collect_set("r")).alias(cut)))
    joined = kept.join(ranges, row, "left").select(*docs.columns, cut)
    at, schema = docs.columns.index(text_col), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for row, found in enumerate(batch.columns[-1].to_pylist()):
                if found and texts[row]:
                    parts, end = [], 0
                    for r in found:
                        parts.append(texts[row][end:r["start"]])
                        end = r["end"]
                    texts[row] = "".join([*parts, texts[row][end:]])
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, arrow[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
    return joined.mapInArrow(run, schema)
