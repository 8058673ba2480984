"""SimHash near-duplicates: vantage-point trees over fingerprints, then components.

Fingerprints that differ in at most ``bits`` bits are linked. Equal fingerprints are one point,
so copies of a text cost nothing more. Points are searched in views: the 64 bits are dealt to
``views`` groups, and two fingerprints within ``bits`` of each other lie within ``bits // views``
of each other in at least one group. Hamming distance inside a group is a metric, so triangle
bounds hold there and are far sharper than over all bits.

For every view a vantage-point tree fitted on a bounded sample deals all points into shards, by
distance to vantage points. A point whose distance lies within the search radius of a boundary
also visits the shards behind it. Each shard goes on with a tree of its own, prunes branches by
the same bounds, compares what is left over all 64 bits, and reports a spanning forest of the
links it found, at most one edge per point, never all pairs. Components come from these edges.

Shards are capped by number, not by content: beyond that they grow with the corpus, by eight
bytes a point, and their own trees keep the comparisons low. A node whose points agree in a
view's bits goes on with distances over all bits.

No words: fingerprint zero, linked like any other. Null text counts as empty. Null ids take
part; the smallest id of a component ignores them. Repeated rows repeat. No rows give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import stored, struct, texts_of, unused
from sigwatch.llm.components import smallest_reachable

WORDS, BITS, VIEWS, SEED = 4, 4, 3, 42
#: Points of a shard, most shards of a view, and sampled points for each shard's tree leaf.
SHARD_ROWS, MAX_SHARDS, SAMPLED = 1 << 14, 4096, 64
#: Comparisons of a node below which a tree stops, and at most held at once.
_LEAF, _BLOCK = 1 << 16, 1 << 22
_SHINGLES = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the hashes of a text's shingles, as an unsigned number."""
    found = text.lower().split()  # bytes: only A-Z fold, only 20 and 09-0D separate
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[min(words, len(found)) - 1:])],
                      dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SHINGLES):
        part = hashes[at:at + _SHINGLES].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


class Rule(NamedTuple):
    """Distance over the bits of ``mask``; linked points are within ``reach`` of each other."""
    mask: int
    reach: int

    def distances(self, points: np.ndarray, vantage: int) -> np.ndarray:
        return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(self.mask)).astype(np.int16)


def view_rules(bits: int, views: int) -> list[Rule]:
    edges = [64 * v // views for v in range(views + 1)]
    return [Rule(((1 << b) - (1 << a)), bits // views) for a, b in zip(edges, edges[1:])]


class Node(NamedTuple):
    rule: Rule
    vantage: int
    cut: int
    inner: Node | int
    outer: Node | int


def _choose(points: np.ndarray, rules: list[Rule]):
    """Vantage point and cut that leave the fewest comparisons; None if none divides the points."""
    for rule in rules:
        best = None
        for vantage in points[np.linspace(0, len(points) - 1, 6).astype(int)]:
            counts = np.bincount(rule.distances(points, int(vantage)), minlength=65)
            inside = np.cumsum(counts)
            for cut in np.flatnonzero(inside[:-1] < len(points)):
                within = int(inside[cut])
                # Inside points near the boundary visit the outside.
                crossing = within - int(inside[cut - rule.reach]) if cut >= rule.reach else within
                outside = len(points) - within
                cost = within ** 2 + outside ** 2 + 2 * crossing * outside
                if within and (best is None or cost < best[0]):
                    best = (cost, rule, int(vantage), int(cut))
        if best and best[0] < 0.9 * len(points) ** 2:
            return best[1:]
    return None


def _divide(rule: Rule, vantage: int, cut: int, points: np.ndarray, visitors: np.ndarray):
    """Residents and visitors of the inside and of the outside.

    Of two residents on either side the inner one crosses; a visitor goes wherever the triangle
    bound leaves a resident possible.
    """
    near, seen = rule.distances(points, vantage), rule.distances(visitors, vantage)
    inside = near <= cut
    crossing = points[inside & (near > cut - rule.reach)]
    return ((points[inside], visitors[seen <= cut + rule.reach]),
            (points[~inside], np.concatenate([visitors[seen > cut - rule.reach], crossing])))


def grow(sample: np.ndarray, rules: list[Rule], leaf_points: float) -> tuple[Node | int, int]:
    """A tree whose leaves, numbered from 0, hold about ``leaf_points`` of the sample."""
    count = 0

    def build(points):
        nonlocal count
        chosen = _choose(points, rules) if len(points) > leaf_points else None
        if chosen is None:
            count += 1
            return count - 1
        (inside, _), (outside, _) = _divide(*chosen, points, points[:0])
        return Node(*chosen, build(inside), build(outside))

    return build(sample), count


def deal(node: Node | int, points: np.ndarray, visitors: np.ndarray) -> Iterator[tuple]:
    """(leaf, residents, visitors) of every leaf that anything reaches."""
    if isinstance(node, int):
        if len(points) or len(visitors):
            yield node, points, visitors
        return
    inner, outer = _divide(node.rule, node.vantage, node.cut, points, visitors)
    yield from deal(node.inner, *inner)
    yield from deal(node.outer, *outer)


class _Forest:
    """Labels of connected points, joined by batches of edges."""

    def __init__(self, size: int):
        self.root, self.waiting, self.held = np.arange(size), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.held += len(a)
        if self.held > _BLOCK:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            a, b = (np.concatenate(side) for side in zip(*self.waiting))
            self.waiting, self.held = [], 0
            while True:
                x, y = self.root[a], self.root[b]
                apart = x != y
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(self.root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
                while (self.root != (up := self.root[self.root])).any():
                    self.root = up
        return self.root


def forest_edges(points: np.ndarray, visitors: np.ndarray, rules: list[Rule], bits: int):
    """Links of residents with residents and visitors, as a spanning forest (a, b)."""
    everyone = np.unique(np.concatenate([points, visitors]))
    forest = _Forest(len(everyone))

    def compare(left, right):
        rows = max(1, _BLOCK // max(1, len(right)))
        for at in range(0, len(left), rows):
            part = left[at:at + rows]
            x, y = np.nonzero(np.bitwise_count(part[:, None] ^ right[None, :]) <= bits)
            forest.add(np.searchsorted(everyone, part[x]), np.searchsorted(everyone, right[y]))

    def search(points, visitors):
        if not len(points):
            return
        if len(points) * (len(points) + len(visitors)) > _LEAF and len(points) > 8:
            chosen = _choose(points[np.linspace(0, len(points) - 1, min(len(points), 512)).astype(int)], rules)
            if chosen is not None:
                inner, outer = _divide(*chosen, points, visitors)
                if len(inner[0]) and len(outer[0]):
                    search(*inner)
                    search(*outer)
                    return
        compare(points, points)
        if len(visitors):
            compare(visitors, points)

    search(points, visitors)
    root = forest.settle()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return everyone[linked], everyone[root[linked]]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                 also: list | None = None) -> DataFrame:
    """Stored: id, ``print`` (the fingerprint's bits as a signed number) and the columns ``also``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    also = also or []
    source = docs.select(id_col, *also, F.col(text_col).cast("binary").alias(unused([id_col], "raw")))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("print", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in texts_of(batch.columns[-1])], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _signed(found)], schema=arrow)
    return stored(source.mapInArrow(run, schema), "fingerprints")


_DEALT = struct(("shard", T.LongType()), ("print", T.LongType()), ("resident", T.BooleanType()))
_EDGE = struct(("a", T.LongType()), ("b", T.LongType()))


def link_edges(points: DataFrame, bits: int = BITS, views: int = VIEWS, shard_rows: int = SHARD_ROWS,
               max_shards: int = MAX_SHARDS) -> DataFrame:
    """Edges (a, b) that connect all linked fingerprints of the stored frame of distinct ``print``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rules, whole = view_rules(bits, views), Rule((1 << 64) - 1, bits)
    total = points.count()
    shards = min(max_shards, -(-total // shard_rows)) or 1
    # A bounded sample in hash order: at most MAX_SHARDS * SAMPLED numbers reach the driver.
    rows = points.select("print").orderBy(F.xxhash64("print")).limit(shards * SAMPLED).collect()
    sample = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    trees, first = [], 0
    for rule in rules:
        tree, leaves = grow(sample, [rule, whole], max(1, len(sample) / shards))
        trees.append((tree, first))
        first += leaves
    arrow, edge_arrow = to_arrow_schema(_DEALT), to_arrow_schema(_EDGE)

    def route(batches):
        for batch in batches:
            here = batch.column(0).to_numpy().view(np.uint64)
            for tree, start in trees:
                found = [(start + leaf, part, stays) for leaf, *parts in deal(tree, here, here[:0])
                         for part, stays in zip(parts, (True, False))]
                if found:
                    leaves, parts, stay = zip(*found)
                    sizes = [len(part) for part in parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array(leaves, np.int64), sizes)),
                         _signed(np.concatenate(parts)), pa.array(np.repeat(stay, sizes))], schema=arrow)

    def search(key, table):
        number = key[0].as_py()
        rule = rules[max(v for v, (_, start) in enumerate(trees) if start <= number)]
        prints = table.column("print").to_numpy().view(np.uint64)
        own = table.column("resident").to_numpy(zero_copy_only=False)
        a, b = forest_edges(np.sort(prints[own]), prints[~own], [rule, whole], bits)
        return pa.Table.from_arrays([_signed(a), _signed(b)], schema=edge_arrow)

    return (points.select("print").mapInArrow(route, _DEALT)
            .groupBy("shard").applyInArrow(search, _EDGE))


def _linked(prints: DataFrame, order, bits: int, **limits) -> DataFrame:
    """``print`` and the least ``order`` of its component, as ``least``."""
    points = stored(prints.groupBy("print").agg(F.min(order).alias("own")), "points")
    smallest = smallest_reachable(link_edges(points, bits, **limits))
    members = stored(points.join(smallest, points["print"] == smallest["a"], "left")
                     .select("print", "own", F.coalesce("b", "print").alias("component")), "members")
    least = members.groupBy("component").agg(F.min("own").alias("least"))
    return members.join(least, "component").select("print", "least")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id",
                    text_col: str = "text", **limits) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = fingerprints(docs, words, id_col, text_col)
    linked = _linked(prints, F.col(id_col), bits, **limits)
    return prints.join(linked, "print").select(
        id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id",
                     text_col: str = "text", **limits) -> DataFrame:
    """The document with the smallest id of each component, whole; null ids come last. Rows with
    the same id and text are one document."""
    mark = unused(docs.columns, "mark")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    prints = fingerprints(marked, words, id_col, text_col, [mark])
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                     F.col(mark).alias("mark"))
    kept = _linked(prints, order, bits, **limits).select("least.*").distinct()
    return marked.join(kept, marked[id_col].eqNullSafe(kept["id"]) & (marked[mark] == kept["mark"]),
                       "left_semi").drop(mark)
