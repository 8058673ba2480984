"""Joins against address lists and node directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sigwatch.constants import BAD_ADDRESSES, BAD_RANGES
from sigwatch.functions.netaddr import IPV4, IPV6, bounds, cidr_keys, ip_key, number_key
from sigwatch.operators.skew import fits, salted_join
from sigwatch.session import stored

BROADCAST_ROWS = 500_000


def _literal(value: str | int) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}L"


def fixed_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Small fixed rows as an inline table, whose size the optimizer knows."""
    lines = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({', '.join(columns)})")


def bad_addresses(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, [(a,) for a in BAD_ADDRESSES], ["ip"])


def bad_ranges(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, [(c, *bounds(c)) for c in BAD_RANGES], ["cidr", "lo", "hi"])


def load_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Address list from a text file: trimmed, no blanks, no repeats."""
    lines = spark.read.text(path).select(F.trim("value").alias("ip"))
    return lines.where(F.length("ip") > 0).distinct()


def ranges_from_cidrs(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Ranges of the networks of either family, as keys; malformed ones are left out."""
    first, last = cidr_keys(F.col(cidr))
    return df.select(cidr, first.alias("first"), last.alias("last")).where("first IS NOT NULL AND last IS NOT NULL")


def _lookup(rows: DataFrame, lookup: DataFrame, on: list[str], spread_by: str, how: str,
            condition: Column | None, broadcast_rows: int) -> DataFrame:
    """Broadcast the list when its size allows it, else a salted shuffle join."""
    if not fits(lookup, broadcast_rows):
        return salted_join(rows, lookup, on, spread_by, how, condition)
    small = F.broadcast(lookup)
    if condition is None:
        return rows.join(small, on, how)
    return rows.join(small, [*[rows[c] == small[c] for c in on], condition], how)


def in_addresses(rows: DataFrame, addresses: DataFrame, ip: str, spread_by: str,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose address is in the list (semi join)."""
    renamed = addresses.select(F.col("ip").alias(ip)).distinct()
    return _lookup(rows, renamed, [ip], spread_by, "left_semi", None, broadcast_rows)


def covered_points(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values of column ``at`` that lie in any of the ranges ``first``..``last`` (ends
    included), by one sweep.

    Starts of ranges and points are sorted together over all partitions. The greatest end so far
    decides about a point; what earlier partitions contribute to it is one value per partition.
    """
    starts = ranges.groupBy(F.col("first").alias("at")).agg(F.max("last").alias("end")).withColumn("point", F.lit(False))
    both = starts.unionByName(points.select("at").where("at IS NOT NULL").distinct()
                              .withColumns({"end": F.lit(None).cast(starts.schema["end"].dataType), "point": F.lit(True)}))
    # Stored, so that partitions stay what they are.
    placed = stored(both.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "sweep")
    parts = placed.groupBy("part").agg(F.max("end").alias("end"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.max("end").over(earlier).alias("before"))  # one row per partition
    so_far = F.max("end").over(Window.partitionBy("part").orderBy("at", "point")
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = placed.withColumn("reach", so_far).where("point").join(F.broadcast(before), "part")
    return swept.where(F.greatest("reach", "before") >= F.col("at")).select("at")


def in_ranges(rows: DataFrame, ranges: DataFrame, ip: str, spread_by: str,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose address lies in any of the ranges, which are pairs of keys (``first``, ``last``)
    or of IPv4 numbers (``lo``, ``hi``).

    Different addresses are swept once; rows then meet the ones found by a semi join, so
    overlapping ranges do not repeat rows and a frequent address is looked up once. Malformed
    addresses lie in no range. Different addresses and the ones found are stored, as each is read
    more than once.
    """
    if "first" not in ranges.columns:
        ranges = ranges.select(number_key(F.col("lo")).alias("first"), number_key(F.col("hi")).alias("last"))
    different = stored(rows.select(ip).distinct().withColumn("at", ip_key(F.col(ip))).where("at IS NOT NULL"), "addresses")
    found = stored(different.join(covered_points(different, ranges), "at", "left_semi").select(ip), "covered")
    return _lookup(rows, found, [ip], spread_by, "left_semi", None, broadcast_rows)


def listed_addresses(rows: DataFrame, addresses: DataFrame | None, ranges: DataFrame | None,
                     ip: str = "src_ip") -> DataFrame:
    """The different addresses of the rows that a list or a range holds."""
    different = rows.select(ip).distinct()
    found = []
    if addresses is not None:
        found.append(in_addresses(different, addresses, ip, ip))
    if ranges is not None:
        found.append(in_ranges(different, ranges, ip, ip))
    return reduce(DataFrame.unionByName, found).distinct()


def valid_candidates(rows: DataFrame, ip: str) -> DataFrame:
    """Well-formed addresses of either family."""
    address = F.col("ip")
    return (rows.select(F.col(ip).alias("ip")).where(address.rlike(IPV4) | address.rlike(IPV6))
            .distinct())


def block_additions(rows: DataFrame, blocklist: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Well-formed addresses not yet on the blocklist (anti join, exact equality)."""
    return valid_candidates(rows, ip).join(blocklist.select("ip").distinct(), "ip", "left_anti")


def block_status(rows: DataFrame, blocklist: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Each candidate with ``success`` when it is new and ``info`` when already blocked."""
    known = blocklist.select("ip").distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known"), "info").otherwise("success")
    return valid_candidates(rows, ip).join(known, "ip", "left").select("ip", status.alias("status"))


def with_node_flags(rows: DataFrame, directory: DataFrame, node: str, spread_by: str,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Node-type flags from a directory of (node, is_hlr, is_gmlc); 1 = other when unknown."""
    renamed = directory.select(F.col("node").alias(node), "is_hlr", "is_gmlc")
    joined = _lookup(rows, renamed, [node], spread_by, "left", None, broadcast_rows)
    return joined.select(
        "*",
        F.coalesce("is_hlr", F.lit(0)).alias("f_same_cggt_is_hlr_ossn"),
        F.coalesce("is_gmlc", F.lit(0)).alias("f_same_cggt_is_gmlc_ossn"),
        F.col("is_hlr").isNull().cast("int").alias("f_c_ossn_others"),
    ).drop("is_hlr", "is_gmlc")
