"""Shards by extendible hashing, with DataFrame functions only.

A row's shard is the shortest prefix of its key's hash below which all rows fit the byte limit.
The directory starts with no bits; only oversized buckets split on another bit. Sizes come from
one aggregation at a depth a little finer than the expected one, rolled up to every shorter
prefix; buckets that are still oversized there go on, alone, with further bits. Rows that share
the whole hash (one key may own a third of the table, or be null) go on with the bits of a hash
of their row number, so a hot key is cut into shards like everything else. Only a single row
larger than the limit keeps a larger shard.

Nothing but the table of cells is shuffled by key, after map-side sums; rows meet their shard
by an equi-join on the cell, which holds less than a shard. Null text has no bytes. No rows
give no rows. Repeated rows each take part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sigwatch.llm.common import stored, unused

LIMIT = 1 << 20
#: Bits of the hash of a key: fifteen hexadecimal digits.
BITS = 60
_FINER, _STEP = 3, 4


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _rounds(facts: DataFrame, hashed: str, first: int, total: float, limit: int):
    """Assign rows by growing prefixes of ``hashed``; also what the last bit could not split."""
    done, start = [], first
    depth = min(BITS, first + max(0, math.ceil(math.log2(max(1, total / limit)))) + _FINER)
    while True:
        cells = (facts.groupBy("base", F.shiftright(hashed, BITS - depth).alias("cell"))
                 .agg(F.sum("bytes").alias("cell_bytes"), F.count("*").alias("cell_rows")))
        above = cells.select("*", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")) \
            .withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        fitting = (above.groupBy("base", "depth", "prefix")
                   .agg(F.sum("cell_bytes").alias("shard_bytes"), F.sum("cell_rows").alias("shard_rows"))
                   .where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)))
        leaf = F.struct("depth", "prefix", "shard_bytes", "shard_rows")
        placed = stored(above.join(fitting, ["base", "depth", "prefix"], "left")
                        .groupBy("base", "cell")
                        .agg(F.min(F.when(F.col("shard_rows").isNotNull(), leaf)).alias("leaf"))
                        .select("base", "cell", "leaf.*"), "cells")
        cell = F.shiftright(hashed, BITS - depth).alias("cell")
        done.append(facts.select("*", cell)
                    .join(placed.where("depth IS NOT NULL"), ["base", "cell"]))
        open_cells = placed.where("depth IS NULL").select("base", "cell")
        if open_cells.isEmpty():
            return done, None
        facts = stored(facts.select("*", cell).join(open_cells, ["base", "cell"]).drop("cell"), "open")
        if depth == BITS:
            return done, facts
        start, depth = depth + 1, min(BITS, depth + _STEP)


def assign_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                  limit: int = LIMIT, keep_rows: bool = False) -> DataFrame:
    """One row per document: its key, bytes, shard (prefix bits, then bits of the row number
    behind a dash), depth, shard_bytes and shard_rows.

    With ``keep_rows`` the row itself comes too, as a struct column ``row``.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    facts = stored(docs.select(
        F.col(key_col).alias("key"), *carried, _bits(key).alias("h"), F.lit("").alias("base"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("number")), "facts")
    total = facts.agg(F.sum("bytes")).first()[0] or 0
    bits = F.expr("lpad(bin(prefix), depth, '0')")
    done, rest = _rounds(facts, "h", 0, total, limit)
    parts = [d.withColumn("shard", bits) for d in done]
    if rest is not None:
        rest = rest.withColumn("base", F.expr(f"lpad(bin(h), {BITS}, '0')")).withColumn(
            "salt", _bits(F.col("number").cast("string")))
        total = rest.agg(F.sum("bytes")).first()[0]
        more, last = _rounds(rest, "salt", 1, total, limit)
        if last is not None:
            raise ValueError("two row numbers share a hash")
        parts += [d.drop("salt").withColumn("shard", F.concat("base", F.lit("-"), bits))
                  .withColumn("depth", F.col("depth") + BITS) for d in more]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    row = ["row"] if keep_rows else []
    return out.select(F.col("key").alias(key_col), "bytes", "shard", "depth", "shard_bytes",
                      "shard_rows", *row)


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> None:
    """Write the rows as Parquet, one folder per shard."""
    assigned = assign_shards(docs, key_col, text_col, limit, keep_rows=True)
    name = unused(docs.columns, "shard")
    # An empty prefix cannot name a folder.
    (assigned.select("row.*", F.concat(F.lit("s"), "shard").alias(name))
     .repartition(name).write.partitionBy(name).parquet(path))
