"""Tokens per document, counted without forming ids.

A first pass gathers the different pre-tokens of the corpus with their occurrences; the tokenizer
then sees each of them once and says how many tokens it makes. A second pass takes each
document's pre-token frequencies and joins them to these counts. The ``FREQUENT`` most common
pre-tokens at most, which make up nearly all occurrences, are joined from a table held by each
worker; its size is bounded by their number and by ``LONGEST`` characters, longer ones standing
there by their SHA-256. All other frequencies are rows and join by a shuffle. As more than
``FREQUENT`` pre-tokens are at least half as common as any of these, no key of that join holds
more than a sliver of the rows.

The counts are those of the library's default: special strings inside a text are one token each
and part the text around them. Null and empty texts have no tokens. Texts of any length are
counted whole. Repeated rows and ids each keep their row; null ids pass through; other columns,
whatever their names, are not read. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import held, release, stored, struct
from sigwatch.llm.packing import vocabulary_file

LIMIT = 512
#: Pre-tokens that workers hold with their counts, and their greatest length there.
FREQUENT, LONGEST = 1 << 19, 64
#: Different pre-tokens, and characters read, after which a task passes on what it has gathered.
_KEPT, _CHARS = 1 << 18, 32 << 20
#: Pre-tokens given to the tokenizer together.
_TOGETHER = 1 << 14


def _unsettled() -> np.ndarray:
    """Whether the class of a code point may differ between versions of Unicode."""
    first, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    # White space outside category Z is the same everywhere but for one code point that lost it.
    table = np.array([(a := first(c)) == "Cn" or (b := now(c)) != a and (a[0] in "LNZ" or b[0] in "LNZ")
                      for c in map(chr, range(0x110000))])
    table[0x180E] = True
    return table


class PreTokenizer:
    """Pre-tokens of texts as a byte-level tokenizer cuts them.

    The published pattern does it, except in texts with code points whose class has changed since
    the first versions of Unicode: those the library cuts itself.
    """

    def __init__(self, content: bytes):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        parts = json.loads(content)
        own = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or not own.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normal forms or added spaces is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.tokenizer = Tokenizer.from_buffer(content)
        added = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(PATTERN).findall
        self.unsettled: np.ndarray | None = None

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            if self.unsettled is None:
                self.unsettled = _unsettled()
            if self.unsettled[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
                return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern(text)

    def __call__(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and how many special strings there are."""
        if self.added is None or not self.added.search(text):
            return Counter(self._pieces(text)), 0
        between = self.added.split(text)
        found = Counter()
        for part in between:
            found.update(self._pieces(part))
        return found, len(between) - 1

    def lengths(self, pieces: list[str]) -> list[int]:
        found = []
        for at in range(0, len(pieces), _TOGETHER):
            found += map(len, self.tokenizer.encode_batch_fast(pieces[at:at + _TOGETHER], add_special_tokens=False))
        return found


def _pre_tokenizer(content: bytes) -> PreTokenizer:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(("pieces", zlib.crc32(content)), lambda: PreTokenizer(content))


_GATHERED = struct(("piece", T.StringType()), ("n", T.LongType()))
_COUNTED = struct(("piece", T.StringType()), ("n", T.LongType()), ("tokens", T.IntegerType()))


def _gather(shared, schema: pa.Schema):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen, read = _pre_tokenizer(shared.value), Counter(), 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())],
                                              schema=schema)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(cut(text)[0])
                    read += len(text)
                    if len(seen) > _KEPT or read > _CHARS:
                        yield rows()
                        seen, read = Counter(), 0
        if seen:
            yield rows()
    return gather


def piece_counts(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """Each pre-token of the corpus once: piece, n (its occurrences), tokens. Stored."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared, schema = _shared(docs, vocabulary), to_arrow_schema(_COUNTED)

    def count(batches):
        cut = _pre_tokenizer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cut.lengths(batch.column(0).to_pylist()), pa.int32())], schema=schema)

    gathered = docs.select(F.col(text_col).cast("string")).mapInArrow(
        _gather(shared, to_arrow_schema(_GATHERED)), _GATHERED)
    return stored(gathered.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(count, _COUNTED), "pieces")


def _shared(docs: DataFrame, vocabulary: str | None):
    with open(vocabulary or vocabulary_file("byte_bpe_50k.json"), "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size


def _key(piece: str) -> str:
    return piece if len(piece) <= LONGEST else "#" + hashlib.sha256(piece.encode()).hexdigest()


def frequent_pieces(counts: DataFrame, most: int = FREQUENT) -> pa.Table:
    """Key and tokens of the pre-tokens that occur at least 2^k times, for the least k that
    leaves ``most`` of them or fewer."""
    by_power = dict(counts.groupBy(F.floor(F.log2("n")).cast("int")).agg(F.count("*")).collect())
    power = 64
    while power > 0 and by_power.get(power - 1, 0) + sum(v for k, v in by_power.items() if k >= power) <= most:
        power -= 1
    long_key = F.concat(F.lit("#"), F.sha2(F.encode("piece", "UTF-8"), 256))
    # floor(log2) decides here too, so that the number is the one just counted.
    return counts.where(F.floor(F.log2("n")) >= power).select(
        F.when(F.length("piece") <= LONGEST, F.col("piece")).otherwise(long_key).alias("key"), "tokens").toArrow()


_FREQUENCY = T.ArrayType(struct(("piece", T.StringType()), ("n", T.IntegerType())))


def _look_up(shared, known, schema: pa.Schema):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cut = PreTokenizer(shared.value)
        table = known.value
        tokens = dict(zip(table.column("key").to_pylist(), table.column("tokens").to_pylist())).get
        row = TaskContext.get().partitionId() << 33
        rest_type = schema.field(schema.names.index("rest")).type
        for batch in batches:
            sizes, sums, rests = [], [], []
            for text in batch.column(1).to_pylist():
                found, total = cut(text) if text else ({}, 0)
                rest = []
                for piece, n in found.items():
                    each = tokens(piece) if len(piece) <= LONGEST else tokens(_key(piece))
                    if each is None:
                        rest.append({"piece": piece, "n": n})
                    else:
                        total += each * n
                sizes.append(len(text.encode()) if text else 0)
                sums.append(total)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(row, row + len(sums)), pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.int64()), pa.array(rests, rest_type)], schema=schema)
            row += len(sums)
    return look_up


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    from pyspark.sql.pandas.types import to_arrow_schema

    context = docs.sparkSession.sparkContext
    counts = piece_counts(docs, vocabulary, text_col)
    known = context.broadcast(frequent_pieces(counts, most))  # at most ``most`` short keys
    schema = T.StructType([docs.schema[id_col], *struct(
        ("row", T.LongType()), ("n_bytes", T.LongType()), ("sum", T.LongType()), ("rest", _FREQUENCY)).fields])
    # Row numbers hold since these rows are stored.
    rows = stored(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        _look_up(_shared(docs, vocabulary), known, to_arrow_schema(schema)), schema).toDF(
            "id", "row", "n_bytes", "sum", "rest"), "frequencies")
    rare = (rows.select("row", F.inline("rest")).withColumnRenamed("n", "times").join(counts, "piece")
            .groupBy("row").agg(F.sum(F.col("times").cast("long") * F.col("tokens")).alias("others")))
    total = F.col("sum") + F.coalesce("others", F.lit(0))
    return (rows.drop("rest").join(rare, "row", "left")
            .select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))
