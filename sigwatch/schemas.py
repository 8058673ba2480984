"""Schemas of the files this package reads; identifiers are always text."""

from __future__ import annotations

from pyspark.sql import types as T

from sigwatch.constants import FEATURE_TABLE, OPERATIONS


def _type_of(column: str) -> T.DataType:
    if column.startswith("f_frequent_") or column == "f_ratio_cl_psi":
        return T.DoubleType()
    if column.startswith("f_count_") or column == "f_msg_count_per_imsi":
        return T.LongType()
    if column.startswith("f_"):
        return T.IntegerType()
    return T.StringType()


def feature_table() -> T.StructType:
    """The labelled feature table written after detection."""
    fields = [T.StructField(c, _type_of(c)) for c in FEATURE_TABLE]
    return T.StructType(fields + [T.StructField("label", T.IntegerType())])


def training_table() -> T.StructType:
    """The labelled training table: row number, context, 43 features, label."""
    flags = ["f_c_ossn_others", "f_same_cggt_is_gmlc_oc", "f_same_cggt_is_gmlc_ossn",
             "f_same_cggt_is_hlr_oc", "f_same_cggt_is_hlr_ossn", "f_velocity_greater_than_1000"]
    middle = ["f_count_unloop_country_last_x_hours_ul", "f_count_gap_ok_sai_and_all_lu"]
    by_name = sorted(OPERATIONS)
    features = (flags + middle + ["f_one_cggt_multi_cdgt_psi"]
                + [f"f_count_ok_{op}_between2lu" for op in by_name]
                + [f"f_frequent_ok_{op}_between2lu" for op in by_name])
    return T.StructType(
        [T.StructField("row_no", T.LongType()), T.StructField("_time", T.StringType()),
         T.StructField("c_timestamp", T.LongType()), T.StructField("c_cggt", T.StringType()),
         T.StructField("c_imsi", T.StringType())]
        + [T.StructField(c, _type_of(c)) for c in features]
        + [T.StructField("label", T.IntegerType())])


SIP_FLOWS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("alert_msg", T.StringType()),
])

IDS_EVENTS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("alert", T.MapType(T.StringType(), T.StringType())),
])
