"""Byte-level BPE encoding and decoding.

Texts are cut into pieces without regular expressions. Code points become classes by one table
lookup. An automaton over these classes follows apostrophe contractions; its transition
functions are composed by an associative scan: inside blocks of fixed length for all start
states at once, then over the blocks by doubling, and a last pass reads each block's states
from its true start. Piece boundaries follow from neighbouring classes and those states. Pieces
are merged by pair rank, lowest first and leftmost among equals, and their ids are remembered.
Byte offsets of tokens come with the ids and cut the decoded bytes.

Null and empty texts have no tokens. Repeated rows repeat. Texts are processed whole: one text
of any length is one piece of work, its merges use a heap, so long runs without a boundary cost
n log n. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import held, struct
from sigwatch.llm.packing import _portions, vocabulary_file

#: Pieces that a worker remembers before it starts anew, and their greatest length.
REMEMBERED, LONGEST = 1 << 19, 64
_CHARS = 2 << 20
_BLOCK = 64

# Classes of code points. The letters that contractions use have classes of their own.
LETTER, NUMBER, OTHER, BLANK, SPACE, APOSTROPHE, STMD, R, V, L, E, CLASSES = range(12)
# States after a code point.
IN_BLANK, IN_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_APOSTROPHE, AFTER_R, AFTER_V, AFTER_L, \
    CONTRACTED, STATES = range(11)

# The white space of Unicode.
_WHITE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
          0x205F, 0x3000]


def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)],
                     dtype=np.uint8)
    table[_WHITE] = BLANK
    table[0x20] = SPACE
    for letters, kind in (("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in letters]] = kind
    return table


def _transitions() -> np.ndarray:
    """State after a code point, by class and state before; then the same at a text's start."""
    table = np.empty((2 * CLASSES, STATES), dtype=np.uint8)
    table[:CLASSES] = np.array([IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANK, IN_SPACE, AFTER_APOSTROPHE,
                                *[IN_LETTERS] * 5], dtype=np.uint8)[:, None]
    table[APOSTROPHE, [IN_OTHERS, IN_SPACE, AFTER_APOSTROPHE]] = IN_OTHERS
    for kind, before, after in ((STMD, AFTER_APOSTROPHE, CONTRACTED), (R, AFTER_APOSTROPHE, AFTER_R),
                                (V, AFTER_APOSTROPHE, AFTER_V), (L, AFTER_APOSTROPHE, AFTER_L),
                                (L, AFTER_L, CONTRACTED), (E, AFTER_R, CONTRACTED),
                                (E, AFTER_V, CONTRACTED)):
        table[kind, before] = after
    table[CLASSES:] = table[:CLASSES, IN_BLANK][:, None]
    return table


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend((_class_table(), _transitions()))
    return _TABLES


def scan_states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state after each code point, by composing transition functions."""
    step = _tables()[1].ravel()
    blocks = -(-len(kinds) // _BLOCK)
    padded = np.zeros(blocks * _BLOCK, dtype=np.intp)
    padded[:len(kinds)] = kinds
    rows = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T) * STATES
    functions = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, blocks))
    for row in rows:
        functions = step[row + functions]
    reach, columns = 1, np.arange(blocks)
    while reach < blocks:
        # Compose each block's function with that of the span before it.
        functions = np.concatenate(
            [functions[:, :reach], functions[functions[:, :-reach], columns[reach:]]], axis=1)
        reach *= 2
    state = np.empty(blocks, dtype=np.uint8)
    state[0], state[1:] = IN_BLANK, functions[IN_BLANK, :-1]
    states = np.empty((_BLOCK, blocks), dtype=np.uint8)
    for at, row in enumerate(rows):
        state = step[row + state]
        states[at] = state
    return np.ascontiguousarray(states.T).reshape(-1)[:len(kinds)]


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start in joined texts whose first code points are at ``starts``."""
    kinds = _tables()[0][points]
    first = np.zeros(len(kinds) + 1, dtype=bool)
    first[starts] = True
    first[-1] = True
    states = scan_states(kinds + np.where(first[:-1], CLASSES, 0).astype(np.uint8))
    groups = np.array([0, 1, 2, 3, 4, 2, 0, 0, 0, 0, 0], dtype=np.uint8)[kinds]
    white = groups >= BLANK
    before, white_before = np.empty_like(groups), np.empty_like(white)
    before[0], before[1:] = BLANK, groups[:-1]
    white_before[0], white_before[1:] = False, white[:-1]
    last_white = np.ones(len(kinds), dtype=bool)
    last_white[:-1] = ~white[1:]
    # White space: a run starts a piece, and its last code point one of its own before text.
    bound = white & (~white_before | (last_white & ~first[1:]))
    bound |= ~white & (before != SPACE) & (groups != before)
    done = np.flatnonzero(states == CONTRACTED)
    single = kinds[done] == STMD
    bound[done[single]] = False
    bound[done[~single] - 1] = False
    after = done + 1
    after = after[after < len(kinds)]
    bound[after[groups[after] == LETTER]] = True
    bound[starts] = True
    return np.flatnonzero(bound)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    if len(parts) > LONGEST:
        return _merge_long(parts, ranks)
    worst = len(ranks)
    pairs = [ranks.get(a + b, worst) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == worst:
            break
        at = pairs.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], worst)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], worst)
    return [ranks[part] for part in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and right[at] < len(parts):
            pair = parts[at] + parts[right[at]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], at, pair))

    for at in range(len(parts) - 1):
        offer(at)
    while heap:
        _, at, pair = heapq.heappop(heap)
        other = right[at]
        if not parts[at] or other >= len(parts) or parts[at] + parts[other] != pair:
            continue
        parts[at], parts[other] = pair, b""
        right[at] = right[other]
        if right[at] < len(parts):
            left[right[at]] = at
        offer(left[at])
        offer(at)
    return [ranks[part] for part in parts if part]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class ByteEncoder:
    def __init__(self, content: bytes):
        self.ranks = read_ranks(content)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = "".join(texts)
        if not joined:
            return [np.empty(0, "<u4")] * len(texts)
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[lengths > 0]
        bounds = piece_starts(np.frombuffer(joined.encode("utf-32-le"), "<u4"), starts)
        first = np.searchsorted(bounds, np.concatenate([ends - lengths, ends[-1:]])).tolist()
        edges = [*bounds.tolist(), len(joined)]
        known, fresh, out = self.known.get, self._ids, []
        for a, b in zip(first, first[1:]):
            out.append(np.frombuffer(b"".join(
                [known(p) or fresh(p) for p in
                 [joined[i:j] for i, j in zip(edges[a:b], edges[a + 1:b + 1])]]), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths


def _encoder(content: bytes) -> ByteEncoder:
    return held(("bytes", zlib.crc32(content)), lambda: ByteEncoder(content))


def _encode(shared, keep_ids: bool, schema: pa.Schema):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for rows in _portions(texts, _CHARS):
                found = encoder.encode(texts[rows])
                keys = batch.column(0)[rows.start:rows.stop]
                if keep_ids:
                    columns = [pa.array(found, pa.list_(pa.int32())),
                               pa.array([encoder.offsets(ids) for ids in found], pa.list_(pa.int64()))]
                else:
                    columns = [
                        pa.array([len(ids) for ids in found], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()
                                  for ids in found]),
                        pa.array([hashlib.sha256(encoder.decode(ids)).hexdigest() for ids in found])]
                yield pa.RecordBatch.from_arrays([keys, *columns], schema=schema)
    return encode


def _shared(docs: DataFrame, vocabulary: str | None):
    with open(vocabulary or vocabulary_file("byte_bpe_50k.tiktoken"), "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size


def _apply(docs, vocabulary, id_col, text_col, fields, keep_ids):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema[id_col], *struct(*fields).fields])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        _encode(_shared(docs, vocabulary), keep_ids, to_arrow_schema(schema)), schema)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Ids and byte offsets of the tokens of each document."""
    return _apply(docs, vocabulary, id_col, text_col,
                  [("ids", T.ArrayType(T.IntegerType())), ("offsets", T.ArrayType(T.LongType()))], True)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Bytes of each row of :func:`encode`, as column ``content``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([encoded.schema[0], T.StructField("content", T.BinaryType())])
    shared, arrow = _shared(encoded, vocabulary), to_arrow_schema(schema)

    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encoder.decode(np.array(ids or [], np.int64))
                                            for ids in batch.column(1).to_pylist()], pa.binary())],
                schema=arrow)
    return encoded.select(encoded.columns[0], "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both, in one pass."""
    return _apply(docs, vocabulary, id_col, text_col,
                  [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()),
                   ("decoded_sha256", T.StringType())], False)
