"""Seeded splits, folds, samples and minority over-sampling.

Random choices are md5 hashes of seed and row id, so they repeat on every run and engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigwatch.operators.skew import TARGET_ROWS, running_count

HASH_RANGE = 2 ** 32
#: Numbers in a matrix or frame that a task of the neighbour search works on at a time.
_CELLS = 1 << 18


def row_hash(seed: int, row_id: str) -> Column:
    """Number in [0, 2**32) from seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _ranked(df: DataFrame, keys: list[str], row_id: str, seed: int, name: str,
            target_rows: float) -> DataFrame:
    return running_count(df, keys, row_hash(seed, row_id), row_id, name, target_rows)


def stratified_split(df: DataFrame, row_id: str, label: str = "label", fraction: float = 0.2,
                     seed: int = 42, exact: bool = False, name: str = "is_holdout",
                     target_rows: float = TARGET_ROWS) -> DataFrame:
    """Mark the holdout rows.

    By default each row is drawn on its own, which moves no data and keeps class shares in
    expectation. ``exact`` takes the rounded-up share of each class, or of all rows when a
    class has fewer than two.
    """
    if not exact:
        drawn = row_hash(seed, row_id) < int(fraction * HASH_RANGE)
        return df.withColumn(name, drawn.cast("int"))
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    smallest, total = sizes.agg(F.min("_size"), F.sum("_size")).first()
    if smallest is None or smallest < 2:
        ranked = _ranked(df, [], row_id, seed, "_rank", target_rows)
        take = F.col("_rank") <= ceil((total or 0) * fraction)
        return ranked.withColumn(name, take.cast("int")).drop("_rank")
    ranked = _ranked(df, [label], row_id, seed, "_rank", target_rows)
    quota = sizes.select(F.col(label).alias("_class"), F.ceil(F.col("_size") * fraction).alias("_quota"))
    joined = ranked.join(quota, ranked[label].eqNullSafe(quota["_class"]))
    return joined.withColumn(name, (F.col("_rank") <= F.col("_quota")).cast("int")).drop(
        "_rank", "_class", "_quota")


def _classes(sizes: DataFrame, most: int = 1000) -> list:
    """Class sizes; a target with more classes than this is no class label."""
    rows = sizes.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes")
    return rows


def kfold(df: DataFrame, row_id: str, label: str = "label", folds: int = 3, seed: int = 42,
          name: str = "fold", target_rows: float = TARGET_ROWS) -> DataFrame:
    """Fold number per row; each class is dealt out evenly in hash order."""
    ranked = _ranked(df, [label], row_id, seed, "_rank", target_rows)
    return ranked.withColumn(name, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def validation_flag(df: DataFrame, row_id: str, fraction: float = 0.15, seed: int = 43,
                    name: str = "is_validation") -> DataFrame:
    """Early-stopping slice, to be kept out of fitting."""
    return stratified_split(df, row_id, fraction=fraction, seed=seed, name=name)


def sample_rows(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows in seeded random order."""
    return df.orderBy(row_hash(seed, row_id), row_id).limit(k)


# Minority over-sampling: exact nearest neighbours by partitioning around pivots.
#
# Every point joins the cell of its nearest pivot. Its neighbours within its own block give
# a bound on the distance of its k-th neighbour; by the triangle inequality only cells that
# reach closer than that bound are searched further. Blocks hold a fixed number of points
# and queries come in portions, so a crowded cell is shared by many tasks.


def _to_matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """How far :func:`_distances` may be off, since its terms cancel."""
    longest = sum(sqrt((m * m).sum(1).max(initial=0.0)) for m in (a, b))
    return sqrt(8 * np.finfo(np.float64).eps * max(1, a.shape[1])) * longest


def _exact(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    gap = points - query
    return np.sqrt((gap * gap).sum(1))


def _pieces(batches: Iterator[pd.DataFrame], columns: int) -> Iterator[pd.DataFrame]:
    """Batches cut so that a matrix of their rows and so many columns has ``_CELLS`` cells at most."""
    rows = max(1, _CELLS // max(1, columns))
    for pdf in batches:
        for start in range(0, len(pdf), rows):
            yield pdf.iloc[start:start + rows]


def _place(pivots: np.ndarray, middle: np.ndarray):
    """Points about the pivots' middle, each with its cell and the distance to its pivot."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches, max(pivots.shape)):
            if len(pdf):
                vectors = _to_matrix(pdf["x"]) - middle
                cell = _distances(vectors, pivots).argmin(1)
                yield pdf.assign(x=list(vectors), cell=cell.astype("int32"), far=_exact(vectors, pivots[cell]))
    return place


def _nearest(k: int):
    def nearest(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(points):
            ids, where = points["point"].to_numpy(), _to_matrix(points["y"])
            for start in range(0, len(queries), 256):
                part = queries.iloc[start:start + 256]
                vectors = _to_matrix(part["x"])
                rough, slack = _distances(vectors, where), _slack(vectors, where)
                for row, (own, limit) in enumerate(zip(part["id"], part["limit"])):
                    keep = min(len(ids), k + 1 + 8)
                    close = np.argpartition(rough[row], keep - 1)[:keep]
                    cut = rough[row][close].max() + 2 * slack
                    close = np.flatnonzero(rough[row] <= cut)
                    gap = _exact(vectors[row], where[close])
                    other = ids[close] != own
                    close, gap = close[other], gap[other]
                    order = np.lexsort((ids[close], gap))[:k]
                    out += [(own, ids[close[i]], float(gap[i])) for i in order
                            if gap[i] <= limit * (1 + 1e-12)]
        return pd.DataFrame(out, columns=["id", "neighbour", "distance"])
    return nearest


def _reach(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray):
    """Other blocks that could hold a point within each query's limit.

    Every pair of query and block carries the query's vector, so pairs leave in frames of at most
    ``_CELLS`` numbers however many blocks there are.
    """
    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max(1, _CELLS // pivots.shape[1])
        for pdf in _pieces(batches, max(pivots.shape)):
            vectors = _to_matrix(pdf["x"])
            gaps = _distances(vectors, pivots) - radius[None, :] - _slack(vectors, pivots)
            near = gaps <= pdf["limit"].to_numpy()[:, None] * (1 + 1e-12)
            rows, cells = np.nonzero(near)
            times = blocks[cells]
            rows, cells = np.repeat(rows, times), np.repeat(cells, times)
            first = np.cumsum(times) - times
            block = np.arange(times.sum()) - np.repeat(first, times)
            other = (cells != pdf["cell"].to_numpy()[rows]) | (block != pdf["block"].to_numpy()[rows])
            rows, cells, block = rows[other], cells[other], block[other]
            for start in range(0, len(rows), most):
                part = slice(start, start + most)
                found = pdf[["id", "x", "limit"]].iloc[rows[part]]
                yield found.assign(to_cell=cells[part].astype("int32"), to_block=block[part].astype("int32"))
    return reach


def nearest_neighbours(points: DataFrame, k: int = 5, block_rows: int = 20_000,
                       max_pivots: int = 1024, seed: int = 42) -> DataFrame:
    """Exact ``k`` nearest other points of each point: (id, neighbour, distance).

    ``points`` has ``id bigint`` and ``x array<double>``. Equal distances go by id.
    """
    total = points.count()
    wanted = max(1, min(max_pivots, int(sqrt(total / 2))))
    pivots = _to_matrix(pd.Series(
        [r["x"] for r in points.orderBy(row_hash(seed, "id"), "id").limit(wanted).collect()]
        or [[0.0]]))
    # Distances come from lengths that cancel; about the middle lengths are as small as they can be.
    middle = pivots.mean(axis=0)
    pivots = pivots - middle
    cells = points.mapInPandas(_place(pivots, middle), "id bigint, x array<double>, cell int, far double")
    stats = {r["cell"]: r for r in cells.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    radius = np.array([stats[c]["radius"] if c in stats else -np.inf for c in range(len(pivots))])
    blocks = np.array([ceil(stats[c]["n"] / block_rows) if c in stats else 0
                       for c in range(len(pivots))])
    count_of = F.element_at(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), F.col("cell") + 1)
    placed = cells.withColumn("block", F.pmod(row_hash(seed, "id"), count_of).cast("int"))

    schema = "id bigint, neighbour bigint, distance double"
    nearest = _nearest(k)

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.rename(columns={"id": "point", "x": "y"})
        return nearest(pdf.assign(limit=np.inf), points)

    own = placed.select("id", "x", "cell", "block").groupBy("cell", "block").applyInPandas(
        in_block, schema)
    # Without k neighbours in the own block there is no bound yet.
    limits = own.groupBy("id").agg(
        F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("limit"))
    queries = (placed.join(limits, "id", "left")
               .withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
               .mapInPandas(_reach(pivots, radius, blocks),
                            "id bigint, x array<double>, limit double, to_cell int, to_block int"))
    # Queries of one block come in portions; each portion meets a copy of the block.
    block_key = ["to_cell", "to_block"]
    portions = queries.groupBy(*block_key).agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("portions"))
    if blocks.sum() <= 1_000_000:  # one row per block
        portions = F.broadcast(portions)
    asked = (queries.join(portions, block_key)
             .withColumn("portion", F.pmod(F.xxhash64("id"), F.col("portions")).cast("int")))
    stored = placed.select(F.col("id").alias("point"), F.col("x").alias("y"),
                           F.col("cell").alias("to_cell"), F.col("block").alias("to_block"))
    held = (stored.join(portions, block_key)
            .withColumn("in_portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
            .select("point", "y", F.col("to_cell").alias("in_cell"),
                    F.col("to_block").alias("in_block"), "in_portion"))
    others = (asked.select("id", "x", "limit", *block_key, "portion").groupBy(*block_key, "portion")
              .cogroup(held.groupBy("in_cell", "in_block", "in_portion"))
              .applyInPandas(nearest, schema))
    # At most k rows per point and block searched.
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (own.unionByName(others).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k))


def smote_quota(df: DataFrame, label: str = "label") -> dict:
    """Minority class and how many rows it lacks."""
    rows = _classes(df.groupBy(label).agg(F.count("*").alias("_size")))
    if len(rows) != 2:
        raise ValueError("over-sampling needs exactly two classes")
    low, high = sorted(rows, key=lambda r: (r["_size"], r[label]))
    return {"minority": low[label], "rows": low["_size"], "missing": high["_size"] - low["_size"]}


def smote_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class before and after over-sampling to equal classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_before"))
    largest = counts.agg(F.max("n_before")).scalar()
    return counts.select(label, "n_before", largest.alias("n_after"))


def smote_rows(df: DataFrame, row_id: str, vector: str, label: str = "label", k: int = 5,
               seed: int = 42, target_rows: float = TARGET_ROWS, **options) -> DataFrame:
    """Synthetic minority rows: (base, neighbour, copy, u, vector), as many as are missing.

    Base rows take turns in hash order; copy number picks the neighbour and the place on
    the segment between both.
    """
    quota = smote_quota(df, label)
    minority = df.where(F.col(label) == quota["minority"])
    points = minority.select(F.col(row_id).cast("bigint").alias("id"),
                             F.col(vector).cast("array<double>").alias("x"))
    k = min(k, quota["rows"] - 1)
    if k < 1:
        raise ValueError("over-sampling needs at least two minority rows")
    each, extra = divmod(quota["missing"], quota["rows"])
    turns = _ranked(points, [], "id", seed, "_rank", target_rows)
    due = F.lit(each) + F.when(F.col("_rank") <= extra, 1).otherwise(0)
    bases = (turns.withColumn("_due", due).where("_due > 0")
             .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_due")))).drop("_due", "_rank"))
    pick = F.concat_ws(":", F.lit(seed), F.col("id"), F.col("copy"))
    draws = F.md5(pick)
    whole = [F.conv(F.substring(draws, at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    drawn = (bases.withColumn("rank", (whole[0] % k + 1).cast("int"))
             .withColumn("u", whole[1] / F.lit(float(HASH_RANGE))))
    linked = drawn.join(nearest_neighbours(points, k, seed=seed, **options)
                        .select("id", "rank", "neighbour"), ["id", "rank"])
    ends = points.select(F.col("id").alias("neighbour"), F.col("x").alias("y"))
    both = linked.join(ends, "neighbour")
    between = F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a))
    return both.select(F.col("id").alias("base"), "neighbour", "copy", "u",
                       between.alias(vector), F.lit(quota["minority"]).alias(label))


def oversample(df: DataFrame, row_id: str, features: list[str], label: str = "label", k: int = 5,
               seed: int = 42, **options) -> DataFrame:
    """Feature and label columns with synthetic minority rows added until classes are equal."""
    rows = df.select(row_id, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), label)
    made = smote_rows(rows, row_id, "_x", label, k, seed, **options)
    columns = [F.col("_x")[i].alias(c) for i, c in enumerate(features)]
    return (rows.select(*columns, F.col(label).cast("int").alias(label))
            .unionByName(made.select(*columns, F.col(label).cast("int").alias(label))))
