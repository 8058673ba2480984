"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class has a model of letters inside words, from labelled documents: n-gram counts at order 6
and continuation counts (how many different letters precede an n-gram) at orders 5 and 4. Below
them both back off to one shared model of orders 1 to 3. Its continuation counts and the totals
and kinds of their contexts come from all n-grams of all documents of the corpus, labelled or not. A word's log-likelihood ratio is thus
near nothing where the classes agree, and rare or unseen words are judged by the parts they share
with known ones.

Ratios are normalised by length in three ways: per word over the whole document, per word over
its most toxic stretch of ``STRETCH`` words, and for its most toxic word. A logistic function of
these, fitted on documents scored by models that have not seen them (two folds), gives a score
from 0 to 1.

The class counts come from at most ``per_class`` labelled documents of either class, the first
in hash order; this bounds the model, which is sent to all tasks. Shared counts, class totals
and scores cover every document. Labels are learnt only from rows with crc32(doc_id) mod 3
other than 1, and neither labels, lang, source nor doc_id enter a score.

Null, empty and wordless texts score as a document without evidence; very long texts are scored
whole. ``drop_toxic`` and ``with_scores`` pass other columns through under any name. A document labelled
several times is toxic if any label says so; null labels are no labels. Without labels of both
classes every score is the share of toxic labels (0 if there are none). No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import ragged, release, stored, struct, unused
from sigwatch.llm.packing import _portions, _runs

ORDER, SHARED, STRETCH, DISCOUNT = 6, 3, 32, 0.75
PER_CLASS = 8_192
THRESHOLD = 0.7
#: Words that a task remembers (their ratio, or that it reported them) before it starts anew, size of
#: texts taken together, and words scored together.
REMEMBERED, _CHARS, _TOGETHER = 1 << 18, 2 << 20, 1 << 13
#: N-grams of an order that a task remembers to have reported.
_TOLD = 1 << 20
FLOOR = 1e-5

_WORD = re.compile(r"[^\W_]+")
#: The words of tokens, each on a line; what ends a line counts as a word.
_IN_LINES = re.compile(r"[^\W_]+|\n")
_EDGE, _END = "\0", "\1"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _tokens(texts: pa.Array) -> pa.ListArray:
    """Parts between ASCII white space, which no word, and no rule of lower case, reaches across:
    the words of a text are those of its tokens."""
    return pc.ascii_split_whitespace(texts)


def _lines(tokens: pa.Array) -> str:
    """Tokens in lower case, a line each."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens)
    return pc.binary_join(whole, pa.scalar("\n", tokens.type))[0].as_py().lower() + "\n"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(words: list[str], order: int = ORDER) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For every order the n-gram and its context at each letter of each word, as hashes, and
    where words end. An end mark counts as a letter; what precedes a word is an edge mark."""
    edge = _EDGE * (order - 1)
    points = np.frombuffer((edge + (_END + edge).join(words) + _END).encode("utf-32-le"), "<u4")
    letters = _mix(points.astype(np.uint64) + np.uint64(7))
    at = np.flatnonzero(points)
    sums, factor, found = letters.copy(), 1, []
    for n in range(1, order + 1):
        before = sums
        if n > 1:
            factor = (factor * int(_ODD)) & ((1 << 64) - 1) | 1
            sums = before.copy()
            sums[n - 1:] += letters[:-(n - 1)] * np.uint64(factor)
        context = _mix(before[at - 1] + np.uint64(100 + n)) if n > 1 else np.zeros(len(at), np.uint64)
        found.append((_mix(sums[at] + np.uint64(n)), context))
    return found, np.flatnonzero(points[at] == 1)


class Lookup:
    """Positions of known hashes, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        waiting, slot = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = waiting[free]
            lost = self.slots[slot] != waiting
            waiting, slot = waiting[lost], (slot[lost] + np.uint64(1)) & self.mask

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        found = np.full(len(wanted), -1, dtype=np.int32)
        open_, slot = np.arange(len(wanted)), wanted & self.mask
        while len(open_) and len(self.keys):
            there = self.slots[slot]
            equal = (there >= 0) & (self.keys[there] == wanted[open_])
            found[open_[equal]] = there[equal]
            go_on = (there >= 0) & ~equal
            open_, slot = open_[go_on], (slot[go_on] + np.uint64(1)) & self.mask
        return found


class Order(NamedTuple):
    """One order's tables; a last entry stands for what is unknown.

    Probability = gain[gram] * scale[context] + rest[context] * probability of the lower order.
    """
    gram: Lookup
    gain: np.ndarray
    context: Lookup
    scale: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, contexts: np.ndarray, counts: np.ndarray,
           sums: tuple[np.ndarray, np.ndarray] | None = None) -> Order:
        """From the counts of n-grams, one row per n-gram and one column per class. Where the rows
        are not all n-grams of their contexts, ``sums`` are each row's context total and kinds."""
        known, first, place = np.unique(contexts, return_index=True, return_inverse=True)
        if sums:
            total, kinds = (of_row[first] for of_row in sums)
        else:
            total, kinds = np.zeros((len(known), counts.shape[1])), np.zeros((len(known), counts.shape[1]))
            np.add.at(total, place, counts)
            np.add.at(kinds, place, counts > 0)
        scale = np.where(total > 0, 1 / np.maximum(total, 1), 0)
        rest = np.where(total > 0, DISCOUNT * kinds * scale, 1)
        gain, wide = np.maximum(counts - DISCOUNT, 0), counts.shape[1]

        def light(values, unknown):
            return np.vstack([values, np.full((1, wide), unknown)]).astype(np.float32)
        return Order(Lookup(keys), light(gain, 0), Lookup(known), light(scale, 0), light(rest, 1))


class Model(NamedTuple):
    orders: list[Order]

    def unread(self) -> np.ndarray:
        """For ``ratios`` to remember letters in: a place for each n-gram of the highest order, and
        a last one that stays empty."""
        return np.full(len(self.orders[-1].gram.keys) + 1, np.nan)

    def ratios(self, words: list[str], read: np.ndarray | None = None) -> np.ndarray:
        """Log-likelihood ratio, toxic against ordinary, of each word. That of a letter depends on
        the n-gram of the highest order alone; ``read`` remembers it for those of the model."""
        if not words:
            return np.empty(0)
        found, ends = grams(words)
        read = self.unread() if read is None else read
        place = self.orders[-1].gram(found[-1][0])
        letters = read[place]
        new = np.flatnonzero(np.isnan(letters))
        chance = np.full((len(new), 1), FLOOR)
        for order, (gram, context) in zip(self.orders, found):
            at = order.context(context[new])
            chance = (order.gain.take(order.gram(gram[new]), axis=0) * order.scale.take(at, axis=0)
                      + order.rest.take(at, axis=0) * chance)
        logs = np.log(chance)
        letters[new] = read[place[new]] = logs[:, 1] - logs[:, 0]
        read[-1] = np.nan
        return np.add.reduceat(letters, np.concatenate([[0], ends[:-1] + 1]))


def features(ratios: np.ndarray) -> tuple[float, float, float]:
    """Mean ratio per word, that of the highest stretch, and the highest of a word."""
    if not len(ratios):
        return 0.0, 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    width = min(STRETCH, len(ratios))
    return float(sums[-1] / len(ratios)), float((sums[width:] - sums[:-width]).max() / STRETCH), float(ratios.max())


class _Scorer:
    """Features of texts; remembers the ratios of words, and those of letters by n-gram. Words are
    looked for once in each different token of the texts taken together."""

    def __init__(self, model: Model):
        self.model, self.known, self.read = model, {}, model.unread()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        lists = _tokens(texts)
        tokens = lists.flatten().dictionary_encode()
        found = _IN_LINES.findall(_lines(tokens.dictionary))
        words = set(found)
        words.discard("\n")
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, words
        if new:
            new = list(new)
            for at in range(0, len(new), _TOGETHER):
                part = new[at:at + _TOGETHER]
                self.known.update(zip(part, self.model.ratios(part, self.read).tolist()))
        self.known["\n"] = np.inf
        ratios = np.fromiter(map(self.known.__getitem__, found), float, len(found))
        ends = np.flatnonzero(ratios == np.inf)
        starts = np.concatenate([[0], ends + 1])[:len(ends)]
        at = tokens.indices.to_numpy()
        held = (ends - starts)[at]
        ratios = ratios[ragged(starts[at], held)]
        ends = np.concatenate([[0], np.cumsum(held)])[np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
        return np.array([features(ratios[a:b]) for a, b in zip([0, *ends], ends)])


def toxic_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id, toxic (0 or 1) and fold (0 or 2) of the labels that may be learnt from."""
    return (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
            .groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
            .withColumn("fold", F.crc32(F.col(id_col).cast("string").cast("binary")) % 3)
            .where("fold <> 1"))


_CLASS_GRAM = struct(("order", T.IntegerType()), ("gram", T.LongType()), ("context", T.LongType()),
                     ("inner", T.LongType()),
                     *[(f"n{i}", T.LongType()) for i in range(4)])
_PRECEDED = struct(("context", T.LongType()), ("gram", T.LongType()), ("longer", T.LongType()))


def _unsigned(column: pa.Array | np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy() if isinstance(column, pa.Array) else column).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _class_grams(sample: DataFrame) -> DataFrame:
    """Counts of n-grams by fold and class (n0..n3: fold 0 ordinary, toxic, fold 2 the same);
    orders of the shared model come without counts that matter. Of an n-gram of higher order,
    ``inner`` is what follows its first letter."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(_CLASS_GRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts, toxic, fold = (column.to_pylist() for column in batch.columns)
            texts = [text or "" for text in texts]
            for rows in _portions(texts, _CHARS):
                counts: dict[str, list[int]] = {}
                for at in range(rows.start, rows.stop):
                    for word in words_of(texts[at]):
                        counts.setdefault(word, [0, 0, 0, 0])[toxic[at] + fold[at]] += 1  # fold is 0 or 2
                words, numbers = list(counts), np.array(list(counts.values()))
                for at in range(0, len(words), _TOGETHER):
                    found, ends = grams(words[at:at + _TOGETHER])
                    weights = np.repeat(numbers[at:at + _TOGETHER],
                                        np.diff(np.concatenate([[-1], ends])), axis=0)
                    for n, (gram, context) in enumerate(found, 1):
                        keys, first, place = np.unique(gram, return_index=True, return_inverse=True)
                        sums = np.stack([np.bincount(place, w) for w in weights.T]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), n, np.int32)), _signed(keys), _signed(context[first]),
                             _signed(found[n - 2][0][first] if n > SHARED + 1 else np.zeros(len(keys), np.uint64)),
                             *map(pa.array, sums)], schema=arrow)

    return (sample.select("text", "toxic", "fold").mapInArrow(run, _CLASS_GRAM)
            .groupBy("order", "gram", "context", "inner").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]))


def _preceded(docs: DataFrame) -> DataFrame:
    """For every n-gram of shared orders in the corpus, its context and how many different letters
    precede it. A task reports a word, or an n-gram with its longer one, again only after it has
    forgotten it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(_PRECEDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[str] = set()
        waiting: list[str] = []
        told = [np.empty(0, np.uint64) for _ in range(SHARED)]

        def tell():
            found, _ = grams(waiting[-2 * _TOGETHER:], SHARED + 1)
            del waiting[-2 * _TOGETHER:]
            for n in range(SHARED):
                # A longer n-gram implies the n-gram inside it, and that its context.
                longer, first = np.unique(found[n + 1][0], return_index=True)
                new = ~np.isin(longer, told[n])
                longer, first = longer[new], first[new]
                told[n] = np.concatenate([told[n], longer]) if len(told[n]) < _TOLD else longer
                yield pa.RecordBatch.from_arrays(
                    [_signed(found[n][1][first]), _signed(found[n][0][first]), _signed(longer)], schema=arrow)

        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for rows in _runs(pc.binary_length(texts).to_pylist(), _CHARS):
                new = set(_WORD.findall(_lines(_tokens(texts[rows]).flatten().unique()))).difference(seen)
                if len(seen) + len(new) > REMEMBERED:
                    seen.clear()
                seen |= new
                waiting.extend(new)
                while len(waiting) > 2 * _TOGETHER:
                    yield from tell()
        if waiting:
            yield from tell()

    return (docs.select("text").mapInArrow(run, _PRECEDED).distinct()
            .groupBy("context", "gram").agg(F.count("*").alias("n")))


def _shared_counts(docs: DataFrame, known: pa.Table) -> pa.Table:
    """For the n-grams of ``known`` (context, gram): n, and total and kinds of their contexts, all
    over the whole corpus. N-grams that ``known`` lacks need no value of their own: no class has a
    longer one, so that their shared probability is the same factor in both classes."""
    counts = stored(_preceded(docs), "preceded")
    sums = counts.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    wanted = counts.join(F.broadcast(docs.sparkSession.createDataFrame(known)), ["context", "gram"])
    return sums.join(F.broadcast(wanted), "context").select("gram", "n", "total", "kinds").toArrow()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps, on standardised columns; the
    coefficients are for the columns as given, the intercept is first."""
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - middle) / spread])
    beta, penalty = np.zeros(z.shape[1]), np.diag([0.0, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - penalty @ beta
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[1:] / spread
    return np.concatenate([[beta[0] - slopes @ middle], slopes])


class Trained(NamedTuple):
    model: Model | None
    beta: np.ndarray
    prior: float


def _apply(shared, schema: pa.Schema, keep: int, finish, at: int = -1):
    """Run a model over the texts in column ``at``; the first ``keep`` columns pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.columns[at], "")
            for rows in _runs(pc.binary_length(texts).to_pylist(), _CHARS):
                found = scorer(texts[rows])
                kept = [c[rows.start:rows.stop] for c in batch.columns[:keep]]
                yield pa.RecordBatch.from_arrays([*kept, *finish(found)], schema=schema)
    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
          text_col: str = "text") -> Trained:
    """Fit on the labelled rows of ``docs``; all of ``docs`` gives the shared counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    context = docs.sparkSession.sparkContext

    learnt = stored(toxic_labels(labels, id_col), "labels")
    totals = {r.toxic: r.n for r in learnt.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    # At most 2 * per_class ids.
    picked = [learnt.where(F.col("toxic") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
              for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(picked[0].unionByName(picked[1]).withColumnRenamed(id_col, "id")),
                               "id").select("toxic", "fold", "text"), "sample")
    table = _class_grams(sample).toArrow()
    if not totals.get(0) or not totals.get(1) or not len(table):
        return Trained(None, np.zeros(4), prior)
    order = table.column("order").to_numpy()
    gram, before, inner = (_unsigned(table.column(c).to_numpy()) for c in ("gram", "context", "inner"))
    counts = np.stack([table.column(f"n{i}").to_numpy() for i in range(4)], axis=1).astype(float)
    by_order = [np.flatnonzero(order == n) for n in range(1, ORDER + 1)]

    corpus = _shared_counts(texts, table.select(["context", "gram"]).take(np.concatenate(by_order[:SHARED])))
    lookup = Lookup(_unsigned(corpus.column("gram").to_numpy()))
    n, total, kinds = (corpus.column(c).to_numpy().astype(float)[:, None] for c in ("n", "total", "kinds"))
    at = [lookup(gram[rows]) for rows in by_order[:SHARED]]
    shared = [Order.of(gram[rows], before[rows], n[a], (total[a], kinds[a])) for rows, a in zip(by_order, at)]

    # For orders above the shared ones, where the n-grams of the next lie among them.
    places = {n: Lookup(gram[by_order[n - 1]])(inner[by_order[n]]) for n in range(SHARED + 1, ORDER)}

    def model(columns):
        orders = list(shared)
        for n in range(SHARED + 1, ORDER + 1):
            rows = by_order[n - 1]
            longer = counts[by_order[min(n, ORDER - 1)]][:, columns].reshape(-1, len(columns) // 2, 2).sum(axis=1)
            if n < ORDER:
                own = np.stack([np.bincount(places[n], seen, len(rows)) for seen in (longer > 0).T], axis=1)
            else:
                own = longer
            seen = own.any(axis=1)
            orders.append(Order.of(gram[rows][seen], before[rows][seen], own[seen]))
        return Model(orders)

    schema = struct(("toxic", T.IntegerType()), *[(f"x{i}", T.DoubleType()) for i in range(3)])
    arrow, found = to_arrow_schema(schema), []
    for fold, other in ((0, [2, 3]), (2, [0, 1])):
        half = context.broadcast(model(other))
        found.append(sample.where(F.col("fold") == fold).select("toxic", "text").mapInArrow(
            _apply(half, arrow, 1, lambda x: [pa.array(np.ascontiguousarray(c)) for c in x.T]), schema).toArrow())
    rows = pa.concat_tables(found)
    y = rows.column("toxic").to_numpy()
    x = np.stack([rows.column(f"x{i}").to_numpy() for i in range(3)], axis=1)
    drawn = np.bincount(y, minlength=2)
    weight = np.array([totals[c] / max(1, drawn[c]) for c in (0, 1)])
    weight *= len(y) / (weight * drawn).sum()
    return Trained(model([0, 1, 2, 3]), _logistic(x, y, weight[y]), prior)


def _scores(trained: Trained, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(trained.beta[0] + x @ trained.beta[1:], -30, 30)))


def with_scores(docs: DataFrame, trained: Trained, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a score per row. Only texts travel to the scoring workers."""
    if trained.model is None:
        return docs.withColumn(name, F.lit(trained.prior))
    shared = docs.sparkSession.sparkContext.broadcast(trained.model)
    light = trained._replace(model=None)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = pc.fill_null(batch, "")
            parts = [_scores(light, scorer(texts[rows]))
                     for rows in _runs(pc.binary_length(texts).to_pylist(), _CHARS)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))
    return docs.withColumn(name, score(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    trained = train(docs, labels, per_class, id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = with_scores(docs.select(id_col, text_col), trained, "score", text_col)
    return scored.select(id_col, held.alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, whole."""
    trained = train(docs, labels, per_class, id_col, text_col)
    name = unused(docs.columns, "score")
    return with_scores(docs, trained, name, text_col).where(F.col(name) < THRESHOLD).drop(name)
