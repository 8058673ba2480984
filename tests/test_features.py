"""Feature formulas on records written by hand."""

import pytest
from pyspark.sql import functions as F

from sigwatch.constants import OPERATIONS
from sigwatch.operators import features


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, c_imsi string, second long, op string, c_cggt string")
    return df.withColumn("ts", F.timestamp_seconds("second").cast("timestamp_ntz"))


def test_counts_gap_and_rates(spark):
    rows = [(1, "a", 100, "cl", "x"), (2, "a", 313, "psi", "x"), (3, "a", 313, "ul", "x"),
            (4, "a", 5000, "sai", "x"), (5, "a", 5010, "sai", "y"), (6, "b", 5010, "sai", "x")]
    full = features.sequence_features(frame(spark, rows), fixed_gap_nodes=["y"])
    got = {r["event_id"]: r for r in full.collect()}
    assert [got[i]["gap_seconds"] for i in range(1, 7)] == [900, 213, 0, 900, 900, 900]
    assert [got[i]["f_count_ok_cl_between2lu"] for i in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    assert [got[i]["f_count_ok_ul_between2lu"] for i in range(1, 7)] == [0, 0, 1, 0, 0, 0]
    assert [got[i]["f_count_ok_sai_between2lu"] for i in range(1, 7)] == [0, 0, 0, 1, 2, 1]
    # 1 record in 213 seconds: 1/214.
    assert got[2]["f_frequent_ok_cl_between2lu"] == pytest.approx(0.0046728971962616)
    assert got[5]["f_frequent_ok_sai_between2lu"] == pytest.approx(2 / 901)
    assert [got[i]["f_count_gap_ok_sai_and_all_lu"] for i in (1, 3, 5)] == [0, -1, 2]
    assert got[1]["f_ratio_cl_psi"] == pytest.approx(11.512935, abs=1e-5)
    assert len([c for c in full.columns if c.startswith("f_count_ok_")]) == len(OPERATIONS)


def test_ulgprs_also_closes(spark):
    rows = [(1, "a", 1, "cl", "x"), (2, "a", 2, "ulgprs", "x"), (3, "a", 3, "cl", "x")]
    got = {r["event_id"]: r["f_count_ok_cl_between2lu"]
           for r in features.between_lu_counts(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_high_activity_edges(spark):
    rows = [(i, "a", s, "cl", "x") for i, s in enumerate([0, 300, 301, 601])]
    got = features.high_activity(frame(spark, rows), window_seconds=300, at_least=2).collect()
    assert {r["event_id"]: r["f_high_activity_5min"] for r in got} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_impossible_travel(spark):
    places = {"madrid": (40.4168, -3.7038), "lima": (-12.0464, -77.0428)}
    plan = [(1, 0, "madrid"), (2, 3600, "lima"), (3, 3600, "lima"), (4, 3600, "madrid"), (5, 90000, "lima")]
    rows = [(i, "a", s, *places[p]) for i, s, p in plan]
    df = spark.createDataFrame(rows, "event_id long, c_imsi string, second long, lat double, lon double")
    df = df.withColumn("ts", F.timestamp_seconds("second").cast("timestamp_ntz"))
    got = {r["event_id"]: r for r in features.impossible_travel(df).collect()}
    assert got[2]["distance_km"] == pytest.approx(9500, rel=0.01)
    assert [got[i]["f_velocity_greater_than_1000"] for i in range(1, 6)] == [0, 1, 0, 1, 0]


def test_fan_out_on_rows(spark):
    rows = [(1, "n1", 0, "psi", "x"), (2, "n2", 10, "psi", "x"), (3, "n1", 20, "cl", "x"),
            (4, "n1", 0, "psi", "y"), (5, "n2", 400, "psi", "x")]
    got = features.with_psi_fan_out(frame(spark, rows), "c_cggt", "c_imsi", "5 minutes").collect()
    assert {r["event_id"]: r["f_one_cggt_multi_cdgt_psi"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
