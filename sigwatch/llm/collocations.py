"""Phrase collocations by SON partitioning.

Words are counted first, exactly. Documents are then dealt into ``SHARDS`` shards. A phrase that
occurs ``support`` times in all occurs at least support / SHARDS times, rounded up, in some shard,
whatever the shards' sizes. So every shard is mined completely at that lowered support, and the
union of what is frequent in some shard misses nothing. Last, all phrases of the union are counted
over all documents, as text, exactly, and the support decides.

Mining works on 64-bit hashes of phrases: a collision can only add to a count, thus only propose
too much. Only phrases whose words all reach the support are mined. Both this set of words and the
union reach the tasks as Bloom filters of at most ``BLOOM_BITS`` bits; what they let through
wrongly is counted like the rest and falls to the support. A filter filled beyond its size costs
work, never results. Tasks combine equal phrases before they shuffle, so a phrase or language that
fills a third of all texts arrives once per batch of a task. Mined hashes travel as arrays by
buckets of the hash, whose number follows the corpus's words; a bucket holds what all shards have
of it and is sorted in one task.

Texts are lower-cased in A to Z, cut into pieces at . , ; : ! ? and the bytes 0A-0D (hex), and
pieces into words at spaces and tabs. Null texts count as empty, null languages as ``und``.
Repeated rows count repeatedly. Words, phrases and texts of any length are taken whole. Ids and
other columns are not read. No rows, or no phrase with enough support, give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import stored, struct

SUPPORT, LONGEST, TOP, COVER = 10, 3, 2000, 50
SHARDS = 4
#: The greatest size of either Bloom filter, in bits; keys set three of them.
BLOOM_BITS, BITS_PER_KEY = 1 << 27, 12
#: Bytes of text looked at together, different entries after which a task passes them on, phrases
#: counted together, hashes sorted together, and hashes of a bucket.
_BYTES, _KEPT, _PORTION, _TOGETHER, _BUCKET = 1 << 20, 1 << 18, 1 << 16, 1 << 20, 1 << 21
#: Texts that reach a Python worker at a time, unless the session asks for fewer.
_ROWS = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
UNKNOWN = "und"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = re.compile(b"[" + _BREAKS + b"]")
_FOLD = bytes(0x0A if b in _BREAKS else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(_ODD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64))


class Words:
    """The words of some texts of one language: where they lie in ``data``, a text with single
    spaces; their hashes; and whether the next word follows in the same piece."""

    def __init__(self, texts: list[bytes], lang: str):
        folded = np.frombuffer(b"\n".join(texts).translate(_FOLD) + b"\n", np.uint8)
        blank = folded == 0x20
        keep = ~blank
        keep[0] = True
        keep[1:] |= ~blank[:-1]
        letters = folded[keep]
        self.data = letters.tobytes()
        word = np.zeros(len(letters) + 1, dtype=bool)
        word[:-1] = (letters != 0x20) & (letters != 0x0A)
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.follows = np.zeros(len(self.starts), dtype=bool)
        if len(self.starts) > 1:
            self.follows[:-1] = (self.starts[1:] - self.ends[:-1] == 1) & (letters[self.ends[:-1]] == 0x20)
        self.hashes = self._hashes(letters, lang)

    def _hashes(self, letters: np.ndarray, lang: str) -> np.ndarray:
        """Polynomials over the letters, from sums up to each place."""
        factor = np.uint64(_ODD)
        back = np.uint64(pow(_ODD, -1, 1 << 64))
        powers = np.cumprod(np.full(len(letters), factor))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[letters] * powers)])
        behind = np.cumprod(np.full(len(letters), back))
        found = (sums[self.ends] - sums[self.starts]) * behind[self.starts]
        return _mix(found ^ np.uint64(zlib.crc32(lang.encode()) * 0x10001))

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all phrases of so many words, and the phrases' hashes."""
        whole = np.ones(max(0, len(self.starts) - size + 1), dtype=bool)
        for at in range(size - 1):
            whole &= self.follows[at:at + len(whole)]
        first = np.flatnonzero(whole)
        hashes = self.hashes[first]
        for at in range(1, size):
            hashes = _mix(hashes + np.uint64(at)) + self.hashes[first + at]
        return first, _mix(hashes + np.uint64(size << 8))

    def texts(self, first: np.ndarray, size: int) -> list[bytes]:
        data = self.data
        return [data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first + size - 1].tolist())]


def _sections(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at a break, so that no piece is parted."""
    at = 0
    while len(text) - at > _BYTES and (found := _BREAK.search(text, at + _BYTES)):
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Words of the texts of (lang, text), by language."""
    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _sections(text or b""):
                waiting.setdefault(lang, []).append(part)
                sizes[lang] += len(part)
                if sizes[lang] >= _BYTES:
                    yield lang, Words(waiting.pop(lang), lang)
                    del sizes[lang]
        for lang, texts in waiting.items():
            yield lang, Words(texts, lang)


class Bloom:
    """Which of the hashes may be known."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - (bits.bit_length() - 1)), words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for turn in range(3):
            place = _mix(hashes + np.uint64(turn)) >> self.shift
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


_PLACE = struct(("word", T.IntegerType()), ("mask", T.LongType()))


def bloom_of(keys: DataFrame, count: int, most_bits: int = BLOOM_BITS) -> Bloom:
    """A Bloom filter of the ``count`` hashes in column ``hash``. Its words, at most
    ``most_bits`` / 64, are set in Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bits, arrow = 64, to_arrow_schema(_PLACE)
    while bits < min(count * BITS_PER_KEY, most_bits):
        bits *= 2
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def places(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            place = np.unique(np.concatenate([_mix(hashes + np.uint64(turn)) >> shift for turn in range(3)]))
            words, at = np.unique(place >> np.uint64(6), return_index=True)
            if len(words):
                masks = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), at)
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(masks.view(np.int64))],
                                                 schema=arrow)
    found = keys.select("hash").mapInArrow(places, _PLACE).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Bloom(bits, words)


_COUNTED = struct(("lang", T.StringType()), ("phrase", T.StringType()), ("size", T.IntegerType()), ("f", T.LongType()))


def _count(choose, schema: pa.Schema):
    """Occurrences by (lang, size, phrase); ``choose`` yields size and first words of those wanted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)
        kept = read = 0

        def rows():
            while seen:
                (lang, size), found = seen.popitem()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()),
                     pa.array([size] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                    schema=schema)
        for lang, words in _read(batches):
            for size, first in choose(words):
                for at in range(0, len(first), _PORTION):
                    found = seen[lang, size]
                    kept -= len(found)
                    found.update(words.texts(first[at:at + _PORTION], size))
                    kept += len(found)
                    if kept > _KEPT:
                        del found
                        yield from rows()
                        kept = 0
            read += len(words.data)
            if read > 64 * _BYTES:
                yield from rows()
                kept = read = 0
        yield from rows()
    return count


def _stored(frame: DataFrame, purpose: str) -> DataFrame:
    """As :func:`stored`, with small Arrow batches meanwhile: texts are long, and a task holds a
    batch of them on either side."""
    conf = frame.sparkSession.conf
    rows = conf.get(_BATCHES)
    if not 0 < int(rows) <= _ROWS:
        conf.set(_BATCHES, _ROWS)
    try:
        return stored(frame, purpose)
    finally:
        conf.set(_BATCHES, rows)


def _counts(texts: DataFrame, choose) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    return (texts.mapInArrow(_count(choose, to_arrow_schema(_COUNTED)), _COUNTED)
            .groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")))


def word_counts(texts: DataFrame) -> DataFrame:
    """Lang, phrase (one word), size (1), f."""
    return _stored(_counts(texts, lambda words: [(1, np.arange(len(words.starts)))]), "words")


_HASH = struct(("hash", T.LongType()))
_MINED = struct(("bucket", T.IntegerType()), ("shard", T.IntegerType()), ("hashes", T.ArrayType(T.LongType())))


def _mine(known, longest: int, shards: int, lowered: int, buckets: int, schema: pa.Schema):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = known.value
        shard = TaskContext.get().partitionId() % shards
        waiting: list[np.ndarray] = []

        def rows():
            hashes, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            # Each hash as often as it was met, but no more often than the lowered support asks for.
            hashes = np.repeat(hashes, np.minimum(n, lowered))
            bucket = ((hashes >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int32)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.array(np.full(len(starts), shard, np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, len(hashes)).astype(np.int32)),
                                          pa.array(hashes.view(np.int64)))], schema=schema)
        for _, words in _read(batches):
            keep = frequent(words.hashes)
            for size in range(2, longest + 1):
                first, hashes = words.phrases(size)
                chosen = keep[first]
                for at in range(1, size):
                    chosen &= keep[first + at]
                waiting.append(hashes[chosen])
            if sum(map(len, waiting)) > _TOGETHER:
                yield rows()
        if waiting:
            yield rows()
    return mine


def _reach(lowered: int, schema: pa.Schema):
    def reach(key, table):
        shard = table.column("shard").to_numpy()
        found = []
        for one in np.unique(shard):
            hashes = pc.list_flatten(table.filter(pa.array(shard == one)).column("hashes")).to_numpy()
            kinds, n = np.unique(hashes, return_counts=True)
            found.append(kinds[n >= lowered])
        return pa.Table.from_arrays([pa.array(np.unique(np.concatenate(found)))], schema=schema)
    return reach


def locally_frequent(texts: DataFrame, frequent: Bloom, total: int, support: int, longest: int,
                     shards: int) -> DataFrame:
    """Hashes of the phrases that reach the lowered support in some shard. ``total`` words set the
    number of buckets that hashes are dealt to, so that buckets stay of one size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    known = texts.sparkSession.sparkContext.broadcast(frequent)  # at most BLOOM_BITS bits
    lowered, buckets = -(-support // shards), max(1, total * (longest - 1) // _BUCKET)
    mined = texts.mapInArrow(_mine(known, longest, shards, lowered, buckets, to_arrow_schema(_MINED)), _MINED)
    return _stored(mined.groupBy("bucket").applyInArrow(_reach(lowered, to_arrow_schema(_HASH)), _HASH), "mined")


def _word_hashes(words: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(_HASH)

    def hashes(batches):
        for _, found in _read(batches):
            yield pa.RecordBatch.from_arrays([pa.array(found.hashes.view(np.int64))], schema=arrow)
    return words.select("lang", F.col("phrase").cast("binary")).mapInArrow(hashes, _HASH)


def phrase_counts(texts: DataFrame, words: DataFrame, support: int = SUPPORT, longest: int = LONGEST,
                  shards: int = SHARDS, most_bits: int = BLOOM_BITS) -> DataFrame:
    """Lang, phrase, size and f of all phrases of 2 to ``longest`` words with support."""
    able = words.where(F.col("f") >= support)
    frequent = bloom_of(_word_hashes(able), able.count(), most_bits)
    total = words.agg(F.sum("f")).first()[0] or 0
    mined = locally_frequent(texts, frequent, total, support, longest, shards)
    union = texts.sparkSession.sparkContext.broadcast(bloom_of(mined, mined.count(), most_bits))

    def choose(words):
        for size in range(2, longest + 1):
            first, hashes = words.phrases(size)
            yield size, first[union.value(hashes)]
    return _stored(_counts(texts, choose).where(F.col("f") >= support), "phrases")


def _part(begin, size):
    return F.array_join(F.slice("words", begin, size), " ")


def scored(phrases: DataFrame, words: DataFrame, longest: int = LONGEST, cover: int = COVER) -> DataFrame:
    """Lang, phrase, a, l, r, score of the phrases that no longer one covers."""
    split = phrases.withColumn("words", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "size", F.col("f").alias("a"), "words",
                        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.inline(F.array(
        F.struct(F.lit(True).alias("left"), _part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))))
    # All parts have the phrase's support or more, so they are in one of the tables.
    known = words.unionByName(phrases).select("lang", F.col("phrase").alias("part"), "f")
    by_cut = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("left"), F.col("f"))).alias("l"),
        F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # Decimals of 38 digits hold these products for counts up to 10^15.
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))"
                   " DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = by_cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    inside = split.where("size > 2").select(
        "lang", "f", F.explode(F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1),"
                                      " b -> array_join(slice(words, b, s), ' '))))")).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return (best.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
            .select("lang", "phrase", "a", "l", "r", "score"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, cover: int = COVER,
                 shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text",
                 most_bits: int = BLOOM_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    words = word_counts(texts)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = scored(phrase_counts(texts, words, support, longest, shards, most_bits), words, longest, cover)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within portions, so that a language's phrases don't all meet in one task.
    portion = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(portion)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
