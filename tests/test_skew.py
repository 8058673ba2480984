"""Sliced operators against brute force, with a key that holds a third of all rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window, functions as F

from sigwatch.operators import features, metrics, rebalance, skew
from sigwatch.operators.lists import in_addresses, in_ranges
from sigwatch.operators.sip import threshold_windows

ROWS, SMALL = 1200, 40


def make_rows(seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * (ROWS // 3) + [None] * 200
    keys += [f"k{rng.randrange(60)}" for _ in range(ROWS - len(keys))]
    rng.shuffle(keys)
    ops = ["cl", "psi", "sri", "sai", "ul"]
    weights = [6, 6, 4, 4, 1]
    return [(i, k, rng.randrange(0, 4000), rng.choices(ops, weights)[0], rng.randrange(5))
            for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def df(spark, rows):
    frame = spark.createDataFrame(rows, "event_id long, c_imsi string, second long, op string, item long")
    return frame.withColumn("ts", F.timestamp_seconds("second").cast("timestamp_ntz"))


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out[r[1]].append(r)
    return out


def test_slicing_finds_hot_key_and_bounds_cells(df):
    keyed = skew.keyed_rows(df, ["c_imsi"], features.micros())
    slicing = skew.find_slicing(keyed, SMALL)
    assert "hot" in slicing.keys and len(slicing.cuts) > 5
    cells = skew.slice_rows(keyed, slicing).groupBy(skew.KEY, skew.SLICE).count()
    assert cells.agg(F.max("count")).first()[0] < 3 * SMALL


def test_no_slicing_below_target(df):
    keyed = skew.keyed_rows(df, ["c_imsi"], features.micros())
    assert skew.find_slicing(keyed, ROWS) == skew.Slicing([], [])


@pytest.mark.parametrize("target", [SMALL, 10 ** 6])
def test_running_count(df, rows, target):
    found = {r["event_id"]: r["f_msg_count_per_imsi"]
             for r in features.message_count(df, target_rows=target).collect()}
    expected = {r[0]: i + 1 for group in by_key(rows).values() for i, r in enumerate(group)}
    assert found == expected


@pytest.mark.parametrize("target", [SMALL, 10 ** 6])
def test_running_sums_include_ties(df, rows, target):
    found = {r["event_id"]: r["total"] for r in skew.running_sums(
        df, ["c_imsi"], features.micros(), {"total": F.col("item")}, target).collect()}
    expected = {r[0]: sum(o[4] for o in group if o[2] <= r[2])
                for group in by_key(rows).values() for r in group}
    assert found == expected


@pytest.mark.parametrize("target", [SMALL, 10 ** 6])
def test_previous_row(df, rows, target):
    got = skew.previous_row(df, ["c_imsi"], features.micros(), "event_id", ["event_id"], "p",
                            only=F.col("op") == "ul", target_rows=target)
    found = {r["event_id"]: r["p"] and r["p"]["event_id"] for r in got.collect()}
    expected = {}
    for group in by_key(rows).values():
        last = None
        for r in group:
            expected[r[0]] = last
            last = r[0] if r[3] == "ul" else last
    assert found == expected


@pytest.mark.parametrize("target", [SMALL, 10 ** 6])
def test_between_lu_counts(df, rows, target):
    got = features.between_lu_counts(df, target_rows=target).collect()
    ops = ["cl", "psi", "sri", "sai", "ul"]
    found = {r["event_id"]: [r[f"f_count_ok_{o}_between2lu"] for o in ops] for r in got}
    expected = {}
    for group in by_key(rows).values():
        counts = dict.fromkeys(ops, 0)
        for r in group:
            counts[r[3]] += 1
            expected[r[0]] = list(counts.values())
            if r[3] == "ul":
                counts = dict.fromkeys(ops, 0)
    assert found == expected


@pytest.mark.parametrize("target", [SMALL, 10 ** 6])
def test_sliding_count(df, rows, target):
    got = skew.sliding_count(df, ["c_imsi"], features.micros(), 300 * 10 ** 6, "n", target)
    found = {r["event_id"]: r["n"] for r in got.collect()}
    expected = {r[0]: sum(r[2] - 300 <= o[2] <= r[2] for o in group)
                for group in by_key(rows).values() for r in group}
    assert found == expected
    assert got.columns == [*df.columns, "n"]


@pytest.mark.parametrize("target", [SMALL, 10 ** 6])
def test_sliding_distinct(df, rows, target):
    got = skew.sliding_distinct(df, ["c_imsi"], "item", features.micros(), 200 * 10 ** 6, "n", target)
    found = {r["event_id"]: r["n"] for r in got.collect()}
    expected = {r[0]: len({o[4] for o in group if r[2] - 200 <= o[2] <= r[2]})
                for group in by_key(rows).values() for r in group}
    assert found == expected


def anchored(times, width, count):
    out, start, n = [], None, 0
    for t in times:
        if start is None or t >= start + width:
            if n >= count:
                out.append((start, alert, n))
            start, n = t, 0
        n += 1
        if n == count:
            alert = t
    if n >= count:
        out.append((start, alert, n))
    return out


@pytest.mark.parametrize("target", [20, 10 ** 6])
@pytest.mark.parametrize("width,count", [(7, 3), (30, 4), (100, 2)])
def test_threshold_windows(spark, df, rows, target, width, count):
    got = threshold_windows(df, F.lit(True), "c_imsi", count, width, target_rows=target)
    found = {(r["c_imsi"], r["s"], r["a"], r["n_messages"]) for r in got.select(
        "c_imsi", F.unix_seconds("window_start").alias("s"), F.unix_seconds("alert_at").alias("a"),
        "n_messages").collect()}
    expected = {(k, *w) for k, group in by_key(rows).items()
                for w in anchored([r[2] for r in group], width, count)}
    assert found == expected


def test_roc_sliced_equals_plain(spark):
    rng = random.Random(3)
    data = [(rng.randrange(2), rng.random() if rng.random() < 0.7 else 0.5) for _ in range(900)]
    frame = spark.createDataFrame(data, "label int, score double")
    plain = {tuple(r) for r in metrics.roc_points(frame).collect()}
    assert {tuple(r) for r in metrics.roc_points(frame, target_rows=30).collect()} == plain
    pairs = [(a > b) + (a == b) / 2 for la, a in data if la for lb, b in data if not lb]
    for target in (30, 10 ** 6):
        area = metrics.roc_auc(frame, target_rows=target).first()[0]
        assert area == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)


def test_exact_split_and_folds_sliced(spark):
    frame = spark.range(700).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    for target in (30, 10 ** 6):
        split = rebalance.stratified_split(frame, "id", exact=True, target_rows=target)
        counts = {r["label"]: r["n"] for r in split.where("is_holdout = 1").groupBy("label")
                  .agg(F.count("*").alias("n")).collect()}
        assert counts == {0: 120, 1: 20}
    plain = {tuple(r) for r in rebalance.kfold(frame, "id").collect()}
    assert {tuple(r) for r in rebalance.kfold(frame, "id", target_rows=30).collect()} == plain
    order = Window.partitionBy("label").orderBy(rebalance.row_hash(42, "id"), "id")
    direct = frame.withColumn("fold", ((F.row_number().over(order) - 1) % 3).cast("int"))
    assert {tuple(r) for r in direct.collect()} == plain


def test_list_joins_same_with_and_without_broadcast(spark):
    rows = spark.createDataFrame(
        [(i, "9.9.9.9" if i % 3 == 0 else f"8.{i % 4}.0.{i % 200}") for i in range(600)],
        "id long, ip string")
    addresses = spark.createDataFrame([("9.9.9.9",), ("8.1.0.5",), ("8.1.0.5",)], "ip string")
    ranges = spark.createDataFrame(
        [(134217728, 134217728 + 65535), (134217728 + 10, 134217728 + 300000),
         (151587081, 151587081)], "lo long, hi long")
    plain, bounds = rows.collect(), ranges.collect()

    def number(ip):
        a, b, c, d = map(int, ip.split("."))
        return ((a * 256 + b) * 256 + c) * 256 + d
    listed = {r["id"] for r in plain if r["ip"] in ("9.9.9.9", "8.1.0.5")}
    inside = {r["id"] for r in plain if any(x["lo"] <= number(r["ip"]) <= x["hi"] for x in bounds)}
    for limit in (0, 1000):
        assert {r["id"] for r in in_addresses(rows, addresses, "ip", "id", limit).collect()} == listed
        assert {r["id"] for r in in_ranges(rows, ranges, "ip", "id", limit).collect()} == inside


def test_only_heavy_keys_of_a_lookup_are_copied(spark):
    from sigwatch.operators.skew import salted_join
    rows = spark.createDataFrame([(i, "hot" if i < 300 else None if i < 500 else f"k{i % 50}") for i in range(700)], "id long, k string")
    lookup = spark.createDataFrame([(k, n) for n, k in enumerate(["hot", "hot", None, *(f"k{i}" for i in range(40))])], "k string, n int")
    at = {k: [r["n"] for r in lookup.collect() if r["k"] == k] for k in {r["k"] for r in rows.collect()} - {None}}
    expected = sorted((r["id"], r["k"], n) for r in rows.where("k IS NOT NULL").collect() for n in at[r["k"]])
    for target, copies in ((1000, 43), (100, 40 + 3 * 8), (0, 43 * 8)):
        seen = spark.sparkContext.accumulator(0)

        def passed(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        kind, real = type(rows), type(rows).join
        kind.join = lambda a, b, *more: real(a, b.mapInArrow(passed, b.schema), *more)
        try:
            for how, wanted in (("inner", expected), ("left", None), ("left_semi", None)):
                joined = salted_join(rows, lookup, ["k"], "id", how, salts=8, target_rows=target)
                got = sorted(map(tuple, joined.collect()), key=str)
                if how == "inner":
                    assert got == sorted(expected, key=str)
                    assert seen.value == copies
                elif how == "left":
                    assert sorted(set(got) - set(expected), key=str) == sorted(
                        ((r["id"], r["k"], None) for r in rows.collect() if not at.get(r["k"])), key=str)
                else:
                    assert {g[0] for g in got} == {e[0] for e in expected}
        finally:
            kind.join = real


def test_reached_blocks_leave_in_small_frames(monkeypatch):
    import numpy as np
    import pandas as pd
    monkeypatch.setattr(rebalance, "_CELLS", 64)
    draw = np.random.default_rng(3)
    pivots = draw.normal(0, 1, (20, 4))
    queries = pd.DataFrame({"id": np.arange(50), "x": list(draw.normal(0, 1, (50, 4))), "cell": np.arange(50) % 20, "block": 0, "limit": np.inf})
    blocks = np.array([2] * 10 + [1] * 9 + [0])
    frames = list(rebalance._reach(pivots, np.full(20, 1.0), blocks)(iter([queries, queries[:0]])))
    assert max(map(len, frames)) <= 16
    found = pd.concat(frames)
    assert all(found["x"].iloc[i] is queries["x"][found["id"].iloc[i]] for i in range(len(found)))
    assert sorted(zip(found["id"], found["to_cell"], found["to_block"])) == [
        (i, c, b) for i in range(50) for c in range(20) for b in range(blocks[c]) if (c, b) != (i % 20, 0)]


def test_neighbours_exact_with_crowded_cells(spark):
    rng = random.Random(5)
    data = [(i, [0.25, 0.5, 0.75] if i < 60 else [rng.random() for _ in range(3)])
            for i in range(180)]
    points = spark.createDataFrame(data, "id long, x array<double>")
    got = rebalance.nearest_neighbours(points, 4, block_rows=16).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["id"], r["rank"])):
        found[r["id"]].append(r["distance"])
    for i, x in data:
        gaps = sorted(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 for j, y in data if j != i)
        assert found[i] == pytest.approx(gaps[:4], abs=1e-9)


@pytest.mark.parametrize("size", [2, 64])
def test_neighbours_far_from_the_origin(spark, size):
    import numpy as np
    draw = np.random.default_rng(9)
    at = 1.6e9 + draw.normal(0, 100, (400, size))
    at[:40] -= 3.2e9  # a second group on the other side
    points = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(at)], "id long, x array<double>")
    found = defaultdict(list)
    for r in sorted(rebalance.nearest_neighbours(points, 4, block_rows=60).collect(), key=lambda r: (r["id"], r["rank"])):
        found[r["id"]].append(r["neighbour"])
    gaps = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    assert found == {i: np.lexsort((np.arange(400), row))[:4].tolist() for i, row in enumerate(gaps)}


def test_smote_points_lie_on_segments(spark):
    rng = random.Random(6)
    data = [(i, [rng.random() for _ in range(3)], int(i < 20)) for i in range(90)]
    frame = spark.createDataFrame(data, "id long, v array<double>, label int")
    made = rebalance.smote_rows(frame, "id", "v", block_rows=8).collect()
    assert len(made) == 50
    at = {i: v for i, v, _ in data}
    assert all(r["base"] != r["neighbour"] and r["base"] < 20 and r["neighbour"] < 20 for r in made)
    for r in made:
        a, b = at[r["base"]], at[r["neighbour"]]
        assert r["v"] == pytest.approx([p + r["u"] * (q - p) for p, q in zip(a, b)])
