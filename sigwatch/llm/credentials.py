"""Secret scans: base patterns, and formats inferred from the credentials they find.

The first pass reads every whole text and stores the credentials in its base spans; it also
counts which character follows which in all texts. For each kind a bounded sample of different
credentials, the first in hash order, is read as a prefix tree whose states merge when they are
statistically compatible: the words that pass two states must agree, within Hoeffding bounds, on
how often each symbol and each class of symbols stands at every place up to ``HORIZON`` ahead, and
on how many words have ended by then. So what lies at equal distance from the end merges, while
length and fixed places survive; longer words turn into loops, and so do all words where they are
too few (about ten) to tell states apart. The second pass takes as candidates
all runs of the credential alphabet, less what base spans cover of them, that have the 6
characters any credential has. A candidate's score is its log-likelihood per character under the
best automaton, less that under the corpus's letter pairs. What reaches the level that nearly all
(``BELOW`` aside) sampled credentials reach under an automaton that has not seen them, ``LEAST`` at
least, is added as a span of kind ``format``. Dots may belong to a credential or end a sentence: a
run is scored with and without the dots at its ends, and where neither fits, the parts between its
dots are.

A kind with a single credential has only its own score as level. Without credentials nothing is
added. Offsets count code points, ends are exclusive. Null text counts as empty, very long texts
and runs are scanned whole. Repeated rows repeat. ``redact`` passes other columns through under
any name. No rows give no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import release, stored, struct, texts_of, unused

KINDS = ("assign", "access", "hex", "format")
#: Different credentials per kind that an automaton is inferred from.
SAMPLE = 1000
#: Level of the bounds, places ahead that they compare, and the share of probability for the unseen.
ALPHA, HORIZON, STRAY = 0.01, 64, 0.01
#: Characters of the shortest credential of the base patterns.
CREDENTIAL = 6
#: Share of sampled credentials that may score below the level, and the least level.
BELOW, LEAST = 0.05, 1.0

# Fixed patterns.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_RUN, _PART = re.compile(rb"[A-Za-z0-9+/_.=-]{6,}"), re.compile(rb"[^.]{6,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

_IS_HEX = bytes(1 if b in b"0123456789abcdef" else 0 for b in range(256))
#: Runs that a task remembers, and the longest of them.
REMEMBERED, _LONG = 1 << 18, 128


def base_matches(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, credential) in order, by byte offsets."""
    found, low = [], text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"\1" * 24 in text.translate(_IS_HEX):
        found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def free_runs(text: bytes, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of the credential alphabet without what taken spans, in order, cover of them."""
    first, reach = 0, np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for run in _RUN.finditer(text):
        start, end = run.span()
        while first < len(taken) and reach[first] <= start:
            first += 1
        for a, b in itertools.takewhile(lambda span: span[0] < end, itertools.islice(taken, first, None)):
            if a - start >= CREDENTIAL:
                yield start, a
            start = max(start, b)
        if end - start >= CREDENTIAL:
            yield start, end


class Automaton(NamedTuple):
    """Probabilistic automaton: per state the log-probabilities of symbols and end, and moves."""
    moves: list[dict[int, int]]
    symbols: list[dict[int, float]]
    ends: list[float]

    def log_likelihood(self, text: bytes) -> float:
        state, total, stray = 0, 0.0, math.log(STRAY / (len(ALPHABET) + 1))
        for symbol in text:
            total += self.symbols[state].get(symbol, stray)
            state = self.moves[state].get(symbol, state)
        return total + self.ends[state]


_CODE = np.full(256, -1)
_CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
_END = len(ALPHABET)
#: Symbols, and their classes (upper case, lower case, digits, marks), as columns of a comparison.
_COMPARED = np.hstack([np.eye(_END + 1, dtype=np.float32), np.stack(
    [[float(a <= c < b) for c in range(_END + 1)] for a, b in ((0, 26), (26, 52), (52, 62), (62, _END))], axis=1)]).astype(np.float32)


def infer(words: list[bytes], alpha: float = ALPHA, horizon: int = HORIZON) -> Automaton:
    """Merge the compatible states of the words' prefix tree.

    A state is known by the words that pass it, each at some place. States are settled outwards
    from the root, those that most words reach first. A new one joins the compatible settled state
    under which the rest of its words is likeliest, and its words go on from there; with no
    compatible one it is settled itself.
    """
    longest = max(map(len, words), default=0)
    codes = np.full((len(words), longest + horizon + 1), _END)
    for row, word in zip(codes, words):
        row[:len(word)] = _CODE[list(word)]
    ahead = np.arange(horizon + 1)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    moves, flow, seen, likely = [], [], [], []
    waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def counts(rows, at):
        found = np.zeros((horizon + 1, _END + 1), np.float32)
        np.add.at(found, (ahead[None, :], codes[rows[:, None], at[:, None] + ahead]), 1)
        return found

    def enter(state, rows, at):
        stack = [(state, rows, at)]
        while stack:
            state, rows, at = stack.pop()
            if state == len(moves):
                moves.append({})
                flow.append(np.zeros(_END + 1))
                seen.append(np.zeros((horizon + 1, _END + 1), np.float32))
                likely.append(None)
            seen[state] += counts(rows, at)
            likely[state] = None
            first = codes[rows, at]
            flow[state] += np.bincount(first, minlength=_END + 1)
            for symbol in np.unique(first[first != _END]).tolist():
                chosen = first == symbol
                if symbol in moves[state]:
                    stack.append((moves[state][symbol], rows[chosen], at[chosen] + 1))
                else:
                    waiting.setdefault((state, symbol), []).append((rows[chosen], at[chosen] + 1))

    def home(rows, at):
        """The settled state that these words join, or a new one."""
        own = counts(rows, at)
        shares, best, place = own @ _COMPARED / len(rows), -math.inf, len(moves)
        for state in range(len(moves)):
            visits = flow[state].sum()
            near = np.abs(shares - seen[state] @ _COMPARED / visits) <= bound * (len(rows) ** -0.5 + visits ** -0.5)
            if near.all():
                if likely[state] is None:
                    likely[state] = np.log(seen[state] / visits + STRAY / (_END + 1))
                fit = float((own * likely[state]).sum())
                if fit > best:
                    best, place = fit, state
        return place

    enter(0, np.arange(len(words)), np.zeros(len(words), np.int64))
    while waiting:
        key = max(waiting, key=lambda k: sum(len(rows) for rows, _ in waiting[k]))
        rows, at = (np.concatenate(found) for found in zip(*waiting.pop(key)))
        state, symbol = key
        moves[state][symbol] = target = home(rows, at)
        enter(target, rows, at)

    def log(state, symbol):
        return math.log((1 - STRAY) * flow[state][symbol] / max(1, flow[state].sum()) + STRAY / (_END + 1))

    return Automaton([{ALPHABET[s]: to for s, to in found.items()} for found in moves],
                     [{ALPHABET[s]: log(q, s) for s in np.flatnonzero(flow[q][:_END]).tolist()} for q in range(len(moves))],
                     [log(q, _END) for q in range(len(moves))])


class Formats(NamedTuple):
    """Inferred automata, the level each must reach, and the corpus's letter pairs."""
    automata: list[Automaton]
    levels: list[float]
    pairs: np.ndarray

    def score(self, text: bytes) -> float:
        """The best automaton's lead over the corpus per character, above its level."""
        codes = np.frombuffer(text, np.uint8)
        ordinary = float(self.pairs[codes[:-1], codes[1:]].sum() + self.pairs[0, codes[0]])
        return max(((a.log_likelihood(text) - ordinary) / len(text) - level
                    for a, level in zip(self.automata, self.levels)), default=-math.inf)

    def places(self, run: bytes) -> tuple[tuple[int, int], ...]:
        """Where a run reaches the level: as a whole, without the dots at its ends, or in parts."""
        left = len(run) - len(run.lstrip(b"."))
        ends = {(0, len(run)), (left, max(left, len(run.rstrip(b"."))))}
        best, place = max((self.score(run[a:b]), (a, b)) for a, b in ends if b - a >= CREDENTIAL)
        if best >= 0:
            return place,
        return tuple(m.span() for m in _PART.finditer(run) if m.span() not in ends and self.score(m[0]) >= 0)


class _Finder:
    """Base spans and added spans of texts; remembers what became of runs."""

    def __init__(self, formats: Formats):
        self.formats, self.known = formats, {}

    def places(self, run: bytes) -> tuple[tuple[int, int], ...]:
        found = self.known.get(run)
        if found is None:
            found = self.formats.places(run)
            if len(run) <= _LONG:
                if len(self.known) >= REMEMBERED:
                    self.known = {}
                self.known[run] = found
        return found

    def __call__(self, text: bytes) -> tuple[list[tuple], list[tuple]]:
        """(start, kind, end, credential) in order, by code points: base spans, and all."""
        base, added = base_matches(text), []
        if self.formats.automata and (base or any(map(self.places, set(_RUN.findall(text))))):
            for start, end in free_runs(text, [(a, b) for a, _, b, _ in base]):
                added += [(start + a, 3, start + b, text[start + a:start + b])
                          for a, b in self.places(text[start:end])]
        spans = _spans(text, base + added)
        return spans[:len(base)], sorted(spans)


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
                      T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
_PAIR = T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("n", T.LongType())])
_BASE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("value", T.StringType())])
_SEEN = struct(("base", T.ArrayType(_BASE)), ("pairs", T.ArrayType(_PAIR)))


def _points(text: bytes, places: list[int]) -> list[int]:
    """Code points before each byte offset; offsets ascend."""
    if text.isascii():
        return places
    out, at, count = [], 0, 0
    for place in places:
        count += len(text[at:place].decode("utf-8", "replace"))
        at = place
        out.append(count)
    return out


def _spans(text: bytes, found: list[tuple[int, int, int, bytes]]) -> list[tuple]:
    places = sorted({place for start, _, end, _ in found for place in (start, end)})
    point = dict(zip(places, _points(text, places)))
    return [(point[start], kind, point[end], value.decode()) for start, kind, end, value in found]


def _scan(schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            base = []
            for text in texts_of(batch.column(0)):
                found = base_matches(text)
                if found:
                    base.append([{"kind": kind, "value": value.decode()} for _, kind, _, value in found])
                codes = np.frombuffer(text, np.uint8)
                for at in range(0, len(codes), 1 << 20):
                    part = codes[max(0, at - 1):at + (1 << 20)].astype(np.int32)
                    pairs += np.bincount(part[:-1] * 256 + part[1:], minlength=1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(base, schema[0].type), pa.nulls(len(base), schema[1].type)],
                                             schema=schema)
        seen = [{"pair": int(pair), "n": int(pairs[pair])} for pair in np.flatnonzero(pairs)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, schema[0].type), pa.array([seen], schema[1].type)], schema=schema)
    return scan


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The first pass, stored: the credentials of texts, and rows with pair counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    return stored(docs.select(F.col(text_col).cast("binary")).mapInArrow(_scan(to_arrow_schema(_SEEN)), _SEEN),
                  "secrets")


def learn(scanned: DataFrame, sample: int = SAMPLE) -> Formats:
    """Infer one automaton per kind from different credentials, the first in hash order."""
    table = (scanned.where("pairs IS NOT NULL").select(F.inline("pairs"))
             .groupBy("pair").agg(F.sum("n").alias("n")).collect())  # at most 65,536 rows
    counts = np.full((256, 256), 0.5)
    for row in table:
        counts[row.pair >> 8, row.pair & 255] += row.n
    pairs = np.log(counts / counts.sum(axis=1, keepdims=True))
    pairs[0] = np.log(counts.sum(axis=0) / counts.sum())  # a run's first character
    found = scanned.where("base IS NOT NULL").select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct()
    automata, levels = [], []
    for kind in range(3):
        words = [r.value.encode() for r in found.where(F.col("kind") == kind)
                 .orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
        if not words:
            continue
        # The level comes from credentials that the automaton scoring them has not seen.
        halves = [Formats([infer(words[i::2] or words)], [0.0], pairs) for i in (0, 1)]
        unseen = [halves[1 - n % 2].score(word) for n, word in enumerate(words)]
        automata.append(infer(words))
        levels.append(max(LEAST, float(np.quantile(unseen, BELOW))))
    return Formats(automata, levels, pairs)


def _with_spans(docs: DataFrame, formats: Formats, text_col: str) -> DataFrame:
    """The second pass: ``docs`` with ``base`` and ``spans`` (base and added spans) in order, as
    arrays of structs, in two more columns at the end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by the samples
    base = unused(docs.columns, "base")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema],
                           T.StructField(base, T.ArrayType(_SPAN)),
                           T.StructField(unused([*docs.columns, base], "spans"), T.ArrayType(_SPAN))])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(shared.value)
        for batch in batches:
            found = [finder((text or "").encode()) for text in batch.column(at).to_pylist()]
            columns = [pa.array([[dict(zip(("start", "kind", "end", "value"), s)) for s in spans] for spans in column],
                                arrow[-1].type) for column in ([f[0] for f in found], [f[1] for f in found])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=arrow)
    return docs.mapInArrow(run, schema)


def _text(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 sample: int = SAMPLE) -> DataFrame:
    """One row per document: its id, counts per base kind, a digest of base spans, all spans."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _with_spans(texts, learn(scan(texts), sample), "text").withColumnRenamed("id", id_col)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select(id_col, *[count(k) for k in range(3)],
                        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
                        _text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]",
           sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one), and the length
    column, where there is one, brought up to date in rows that changed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kept = stored(docs, "kept")
    shared = docs.sparkSession.sparkContext.broadcast(learn(scan(kept, text_col), sample))  # bounded by the samples
    at, schema = docs.columns.index(text_col), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    size = docs.columns.index(length_col) if length_col in docs.columns else None
    arrow = to_arrow_schema(schema)

    def run(batches):
        release()
        finder = _Finder(shared.value)
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            changed = {}
            for row, text in enumerate(texts):
                _, found = finder((text or "").encode())
                if found:
                    parts, end = [], 0
                    for start, _, stop, _ in found:
                        if start >= end:
                            parts += [text[end:start], mark]
                        end = max(end, stop)
                    texts[row] = changed[row] = "".join([*parts, text[end:]])
            columns[at] = pa.array(texts, arrow[at].type)
            if size is not None:
                columns[size] = pa.array([len(changed[row]) if row in changed else old for row, old in
                                          enumerate(columns[size].to_pylist())], arrow[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
    return kept.mapInArrow(run, schema)
