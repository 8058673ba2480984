"""SimHash links against all pairs."""

import numpy as np
import pytest
import xxhash

from sigwatch.llm import simhash
from sigwatch.llm.components import smallest_reachable

SF = "/root/testdata/sf0.001"


def plain_print(text, size=4):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split(b" ")]
    words = [w for part in words for w in part.split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """Smallest reachable position by all pairs."""
    label = list(range(len(prints)))
    values = np.array(prints, np.uint64)
    changed = True
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(prints))]
        changed, label = new != label, new
    return label


def rows_of(frame):
    return {r[0]: (r[1], r[2]) for r in frame.collect()}


def expected(rows):
    rows = sorted(rows)
    prints = [plain_print(t or "") for _, t in rows]
    return {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, components(prints))}


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 8}, {"shard_rows": 20, "views": 2}, {"shard_rows": 30, "views": 1}])
def test_documents_match_all_pairs(spark, limits):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(simhash.near_duplicates(docs, **limits)) == expected(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "É é x y z"), (7, "é é x y z"),
            (8, "a b c d"), (9, "word " * 50000), (10, "word " * 50001)]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, print string, mark int")
    assert rows_of(simhash.near_duplicates(frame)) == expected(rows)
    kept = simhash.drop_near_copies(frame.unionByName(frame.where("doc_id = 8")))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        [c for _, c in set(expected(rows).values())] + [8])
    nameless = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(nameless).collect()] == [None, None]
    assert simhash.drop_near_copies(nameless).count() == 2
    empty = frame.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("views", [1, 2, 3, 4])
def test_trees_lose_no_link(views):
    random = np.random.default_rng(views)
    base = random.integers(0, 1 << 63, 1500, dtype=np.uint64) * 2
    near = base[:700].copy()
    for _ in range(4):
        near ^= np.uint64(1) << random.integers(0, 64, 700, dtype=np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, dense]))
    rules, whole = simhash.view_rules(4, views), simhash.Rule((1 << 64) - 1, 4)
    found = np.arange(len(points))
    edges = []
    for rule in rules:
        tree, leaves = simhash.grow(points[::3], [rule, whole], 60)
        assert leaves > 4
        dealt = list(simhash.deal(tree, points, points[:0]))
        assert sum(len(r) for _, r, _ in dealt) == len(points)
        for _, residents, visitors in dealt:
            edges += list(zip(*simhash.forest_edges(residents, visitors, [rule, whole], 4)))
    forest = simhash._Forest(len(points))
    a, b = (np.searchsorted(points, np.array(side, np.uint64)) for side in zip(*edges))
    forest.add(a, b)
    assert forest.settle().tolist() == components(points)
    assert (np.bitwise_count(points[a] ^ points[b]) <= 64).all()


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    frame = spark.createDataFrame(path, "a long, b long")
    found = {r.a: r.b for r in smallest_reachable(frame).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{101 + i: 100 for i in range(50)}}
