"""Packing by concatenating token streams and cutting them into fixed windows.

The first pass tokenises each document once, on the task that reads it, and stores the ids with
the document's start inside its partition. Partition totals (one number per partition) are
summed up to the partitions' global starts. The second pass adds the two and cuts at multiples
of the window, so no token is shuffled. A window inside one partition is complete there; only
windows that span partitions leave boundary records, which are joined by window. This places
pieces (:func:`pieces`) and fills windows with ids (:func:`sequences`).

Every document ends with the end id, so null and empty texts pack one token. All windows but
the last are full. Repeated rows pack repeatedly, in order of the stored rows; ids of any
value, null included, pass through. Texts of any length are tokenised and cut whole. Columns other
than id and text are not read, and the id column may have any name. No rows give no pieces.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import held, ragged, stored, struct, unused

WINDOW = 4096
END_ID = 2
#: Words and stems whose ids a worker remembers before it starts anew, and their greatest length.
REMEMBERED, _LONGEST = 1 << 17, 64
#: Documents tokenised together, by bytes, so that long texts don't add up.
_BYTES = 2 << 20
_TOGETHER = 1000
_MARKS = ".,!?"


def vocabulary_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space; remembers the ids of word stems.

    Texts are cut at spaces and line ends, which no token crosses and over which no normal form
    composes. Each different word of some texts is looked at once. Marks behind a word's last
    letter are tokens of their own, so its stem is looked up without them. Stems of lower-case
    letters of ASCII need no normal form and go straight to the merges; other stems of letters go
    to the tokenizer many at a time, each ending with the one token that carries the end of a word.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(content)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array(self.kind.char, e.ids).tobytes() for e in encoded]

    def _encode_ascii(self, words: list[str]) -> list[bytes]:
        merged, kind = self.tokenizer.model.tokenize, self.kind.char
        return [array(kind, [token.id for token in merged(word)]).tobytes() for word in words]

    def _encode_letters(self, words: list[str]) -> Iterator[bytes]:
        groups = [words[i:i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for group, joined in zip(groups, self._encode([" ".join(group) for group in groups])):
            ids = np.frombuffer(joined, self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group):
                size = self.kind.itemsize
                yield from (joined[a * size:b * size] for a, b in zip([0, *ends[:-1]], ends))
            else:  # a letter whose lower case is no single letter
                yield from self._encode(group)

    @staticmethod
    def _cut(word: str) -> tuple[str, str]:
        """Stem and marks; a word that can't be cut there is its own stem."""
        stem = word.rstrip(_MARKS)
        # The tokenizer composes, then folds case; a mark left at the end would join the tail.
        last = stem[-1:] if stem.isascii() else unicodedata.normalize("NFC", stem[-1]).lower()[-1:]
        return (stem, word[len(stem):]) if last.isalpha() else (word, "")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't remembered: lower-case stems of ASCII, or any words."""
        plain = [word for word in words if word.isascii() and word.isalpha() and word.islower()]
        found = dict(zip(plain, self._encode_ascii(plain)))
        cut = {word: self._cut(word) for word in words if word not in found}
        new = {piece for pieces in cut.values() for piece in pieces}.difference(self.known, found)
        letters = [piece for piece in new if piece.isalpha()]
        rest = [piece for piece in new if not piece.isalpha()]
        pieces = dict(zip(letters, self._encode_letters(letters))) | dict(zip(rest, self._encode(rest)))

        def ids(piece):
            return pieces[piece] if piece in pieces else found[piece] if piece in found else self.known[piece]
        return found | {word: ids(stem) + ids(tail) for word, (stem, tail) in cut.items()}

    def _ids_of(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, words))
        missed = [at for at, found in enumerate(ids) if found is None]
        new = self._learn([words[at] for at in missed])
        for at in missed:
            ids[at] = new[words[at]]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {"": b""}
        self.known.update((word, found) for word, found in new.items() if len(word) <= _LONGEST)
        return ids

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        found = split.flatten().dictionary_encode()
        words = found.dictionary
        stems = pc.utf8_rtrim(words, _MARKS)
        plain = pc.and_(pc.string_is_ascii(stems), pc.ascii_is_alpha(stems))
        # Of plain words the stem without case, and its marks; of others the word itself.
        keys = pc.if_else(plain, pc.ascii_lower(stems), words).dictionary_encode()
        marked = np.flatnonzero(pc.and_(plain, pc.greater(pc.binary_length(words), pc.binary_length(stems))))
        tails = [word[len(stem):] for word, stem in zip(*(x.take(pa.array(marked)).to_numpy(zero_copy_only=False)
                                                          for x in (words, stems)))]
        pieces = keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = {tail: at for at, tail in enumerate(["", *set(tails)], len(pieces))}
        known = self._ids_of(pieces + list(place))
        codes = np.full((len(words), 2), len(pieces))
        codes[:, 0] = keys.indices.to_numpy()
        codes[marked, 1] = [place[tail] for tail in tails]
        # Ids of each different word, then of each word in order.
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        starts, pairs = np.cumsum(lengths) - lengths, codes.ravel()
        ids = np.frombuffer(b"".join(known), self.kind)[ragged(starts[pairs], lengths[pairs])]
        lengths, order = lengths[codes].sum(axis=1), found.indices.to_numpy()
        starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        ends = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy()[1:]]
        return ids[ragged(starts, lengths)], ends

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.joined(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, ends[:-1])][:len(texts)]


def _encoder(content: bytes) -> WordEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    pa.default_memory_pool().release_unused()
    return held(("words", zlib.crc32(content)), lambda: WordEncoder(content))


def _runs(lengths: Iterable[int], limit: int) -> Iterator[slice]:
    """Runs of about ``limit`` in sum."""
    start = at = held = 0
    for at, length in enumerate(lengths, 1):
        held += length
        if held >= limit:
            yield slice(start, at)
            start, held = at, 0
    if start < at:
        yield slice(start, at)


def _portions(texts: list[str], limit: int) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters."""
    return _runs(map(len, texts), limit)


def _tokenise(shared, end_id: int, schema: pa.Schema):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, begin = _encoder(shared.value), 0
        size, part = encoder.kind.itemsize, TaskContext.get().partitionId()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for rows in _runs(pc.binary_length(texts).to_pylist(), _BYTES):
                ids, ends = encoder.joined(texts[rows])
                ids = np.insert(ids, ends, end_id)
                counts = np.diff(ends, prepend=0) + 1
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(np.full(len(ends), part, np.int32)),
                     pa.array(begin + ends - counts), pa.array(counts), pa.array(np.full(len(ends), size, np.int32)),
                     pa.Array.from_buffers(pa.binary(), len(ends), [
                         None, pa.py_buffer(np.concatenate([[0], ends * size]).astype(np.int32)), pa.py_buffer(ids)])],
                    schema=schema)
                begin += int(ends[-1])
    return tokenise


def tokenised(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, stored: id, part, start in the part, tokens, width of an id, ids."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(vocabulary or vocabulary_file("word_bpe_49k.json"), "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size
    schema = struct((id_col, docs.schema[id_col].dataType), ("part", T.IntegerType()),
                    ("start", T.LongType()), ("tokens", T.LongType()), ("width", T.IntegerType()),
                    ("ids", T.BinaryType()))
    return stored(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        _tokenise(shared, end_id, to_arrow_schema(schema)), schema), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Add ``begin``, the tokens before each document in the whole stream, and those before its
    partition and up to the partition's end."""
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    begins = itertools.accumulate((row.n for row in totals), initial=0)
    offsets = tokens.sparkSession.createDataFrame(
        [(row.part, begin, begin + row.n) for row, begin in zip(totals, begins)],
        "part int, part_begin long, part_end long")
    # One row per partition of the first pass.
    return (tokens.join(F.broadcast(offsets), "part")
            .withColumn("begin", F.col("start") + F.col("part_begin")))


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for data, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist()):
        yield np.frombuffer(data, f"<u{width}").astype("<u4")


def _cuts(begin: int, count: int, window: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces."""
    at = 0
    while at < count:
        length = min(count - at, window - (begin + at) % window)
        yield at, length
        at += length


def _cut(id_col: str, window: int, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            places = zip(*(batch.column(c).to_pylist() for c in ("begin", "part_begin", "part_end")), _ids(batch))
            for row, (begin, first, behind, ids) in enumerate(places):
                for at, length in _cuts(begin, len(ids), window):
                    number = (begin + at) // window
                    inside = first <= number * window and (number + 1) * window <= behind
                    source.append(row)
                    rows.append((at, length, zlib.crc32(ids[at:at + length].tobytes()), len(ids), number,
                                 (begin + at) % window if inside else None, begin + at))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(source, pa.int64())),
                     *(pa.array(v, pa.int64()) for v in zip(*rows))], schema=schema)
    return cut


def pieces(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second pass: where each piece of each document lies.

    Pieces of windows inside one partition are placed there. Those of windows over a border of
    partitions are boundary records without a place, which meet by window and are set in a row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    id_col = tokens.columns[0]
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    last = unused([id_col, *names], "place")
    schema = T.StructType([tokens.schema[0], *struct(*[(n, T.LongType()) for n in (*names, last)]).fields])
    cut = stored(placed(tokens).mapInArrow(_cut(id_col, window, to_arrow_schema(schema)), schema), "pieces")
    # A window holds at most ``window`` tokens, so its records are few.
    row = Window.partitionBy("sequence_id").orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    border = (cut.where(F.col("offset").isNull())
              .withColumn("offset", F.coalesce(F.sum("length").over(row), F.lit(0))))
    return cut.where(F.col("offset").isNotNull()).unionByName(border).drop(last)


_FRAGMENT = struct(("sequence_id", T.LongType()), ("offset", T.LongType()),
                   ("ids", T.ArrayType(T.LongType())), ("whole", T.BooleanType()))


def _fill(window: int, schema: pa.Schema):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*found), schema)], schema=schema)

        open_windows: dict[int, list] = {}
        for batch in batches:
            full = []
            for begin, ids in zip(batch.column("begin").to_pylist(), _ids(batch)):
                for at, length in _cuts(begin, len(ids), window):
                    number, offset = divmod(begin + at, window)
                    held = open_windows.setdefault(number, [])
                    held.append((offset, ids[at:at + length]))
                    if sum(len(i) for _, i in held) == window:
                        joined = np.concatenate([i for _, i in sorted(held, key=lambda h: h[0])])
                        full.append((number, 0, joined, True))
                        del open_windows[number]
            # Rows come in order, so at most the first and the last window stay open.
            if full:
                yield rows(full)
        rest = [(n, offset, ids, False) for n, held in open_windows.items() for offset, ids in held]
        if rest:
            yield rows(rest)
    return fill


def sequences(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """The packed windows: sequence_id, ids. Only boundary records are shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    filled = stored(placed(tokens).mapInArrow(_fill(window, to_arrow_schema(_FRAGMENT)), _FRAGMENT),
                    "windows")
    # A window holds at most ``window`` tokens, so its records are few.
    joined = filled.where("NOT whole").groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))),
                              lambda piece: piece["ids"])).alias("ids"))
    return filled.where("whole").select("sequence_id", "ids").unionByName(joined)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pieces(tokenised(docs, vocabulary, end_id, id_col, text_col), window)
