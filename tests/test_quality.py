import pytest
from pyspark.sql import Observation, functions as F

from sigwatch.functions.checks import to_number, valid_imsi, valid_timestamp
from sigwatch.operators import quality


def values(spark, column, texts, kind="string"):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


def test_imsi(spark):
    texts = ["242011111111100", "24201111111110", "24201111111110x", "", None,
             "242011111111100.0", "002011111111100", "242011111111100\n", "٢٤٢٠١١١١١١١١١٠٠"]
    assert values(spark, valid_imsi, texts) == [True, False, False, False, False, True, True, False, False]
    assert values(spark, valid_imsi, [242011111111100, 5], "long") == [True, False]
    assert values(spark, valid_imsi, [242011111111100.0, 242011111111100.5, float("nan"), float("inf"), None], "double") == [
        True, False, False, False, False]


def test_timestamps(spark):
    texts = ["2024-01-02 03:04:05", "2022-02-19T22:22:56.000+01:00", "2025-06-04T23:52:29.162238+0000",
             "2024-01-02T03:04:05Z", "1645305776", "2024-02-30 00:00:00", "soon", "", None,
             "999999999999999", "2024-01-02", "-1"]
    assert values(spark, valid_timestamp, texts) == [
        True, True, True, True, True, False, False, False, False, False, True, True]
    own = lambda c: valid_timestamp(c, "dd.MM.yyyy")
    # The caller's format is tried first and does not rule out the others.
    assert values(spark, own, ["31.12.2024", "2024-01-02 03:04:05", "99.12.2024"]) == [True, True, False]


def test_numbers(spark):
    assert values(spark, to_number, ["1", " 2.5 ", "x", "", None, "NaN", "1e3"]) == [
        1.0, 2.5, None, None, None, None, 1000.0]


def test_validation_counts_and_observation(spark):
    rows = [("242011111111100" if i % 1000 >= 92 else "1", "2024-01-02 03:04:05", i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "c_imsi string, c_timestamp string, i int")
    seen = Observation("validation")
    kept = quality.clean(frame, ["c_imsi", "c_timestamp"], observe=seen)
    assert kept.count() == 908
    assert seen.get == {"rows_in": 1000, "rows_valid": 908, "rows_invalid": 92}
    assert quality.validate(frame, remove_invalid=False).count() == 1000
    none = frame.withColumn("c_imsi", F.lit("x"))
    report = quality.validation_report(none).first().asDict()
    assert report == {"rows_in": 1000, "rows_valid": 0, "rows_invalid": 1000, "duplicates": 0, "rows_out": 0}
    # A check whose column is absent passes.
    assert quality.validate(frame.drop("c_timestamp")).count() == 908


def test_required_columns(spark):
    with pytest.raises(quality.MissingColumns, match="c_imsi, c_timestamp"):
        quality.clean(spark.createDataFrame([(1,)], "label int"), ["c_imsi", "c_timestamp", "label"])


def test_duplicates(spark):
    frame = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "b", 1), (2, "b", 1), (9, None, 0), (8, None, 5)],
                                  "seq int, k string, v int")
    assert quality.distinct_rows(frame).count() == 5
    first = quality.first_of_each(frame, ["k"], ["seq"])
    assert {tuple(r) for r in first.collect()} == {(1, "a", 1), (2, "b", 1), (8, None, 5)}
    assert first.columns == frame.columns
    again = quality.first_of_each(first, ["k"], ["seq"])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in first.collect()}


def test_target(spark):
    frame = spark.createDataFrame([("1",), ("0",), (None,), ("x",), ("2",)], "label string")
    assert sorted(r[0] for r in quality.clean_target(frame).collect()) == [0, 1, 2]
    assert [tuple(r) for r in quality.unexpected_targets(quality.clean_target(frame)).collect()] == [(2, 1)]
    with pytest.raises(quality.SingleClass):
        quality.clean_target(frame.where("label = '1'"))


def test_class_weight_fallback(spark):
    def weight(labels):
        frame = spark.createDataFrame([(v,) for v in labels], "label int")
        return quality.class_weight(frame).first()["pos_weight"]
    assert weight([0, 0, 0, 1]) == 3.0
    assert weight([0, 0]) == 1.0
    assert weight([1]) == 0.0
    assert weight([0, 1, 2]) == 1.0


def test_imputer_fits_on_training_rows(spark):
    frame = spark.createDataFrame([(1.0, 0), (3.0, 0), (None, 1), (100.0, 1)], "f_a double, holdout int")
    model = quality.fit_imputer(frame.where("holdout = 0"), ["f_a"])
    assert [r["f_a"] for r in model.transform(frame).collect()] == [1.0, 3.0, 2.0, 100.0]


def test_summary(spark):
    frame = spark.range(10352).withColumn("label", (F.col("id") < 1573).cast("int"))
    row = quality.dataset_summary(frame).first()
    assert row["num_samples"] == 10352 and row["fraud_ratio"] == pytest.approx(0.151951313, abs=1e-9)


def test_type_suffixes_are_no_numbers(spark):
    assert values(spark, to_number, ["12d", "3f", "0x1p3", "1.", ".5", "-2E2", "inf", "1e"]) == [
        None, None, None, 1.0, 0.5, -200.0, float("inf"), None]
    assert values(spark, valid_timestamp, ["12d", "3f", "0x1p3", "12", " 12.5 "]) == [False, False, False, True, True]


def test_first_line_in_files_stays(spark, tmp_path):
    from pyspark.sql import types as T

    from sigwatch.sources.tables import read_csv
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    first = {}
    for n in range(3):
        lines = [(f"k{(n * 7 + i * i) % 50}", n * 10_000 + i) for i in range(3000)]
        (tmp_path / f"{n}.csv").write_text("k,v\n" + "".join(f"{k},{v}\n" for k, v in lines))
        for k, v in lines:
            first.setdefault(k, v)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many blocks, packed out of order
    try:
        lines = read_csv(spark, str(tmp_path), schema, file_order=True)
        assert lines.rdd.getNumPartitions() > 5
        kept = quality.clean(lines, ["k"], duplicate_subset=["k"])
        assert kept.columns == ["k", "v"] and {r.k: r.v for r in kept.collect()} == first
        assert quality.clean(lines, ["k"]).count() == 9000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError, match="order"):
        quality.clean(read_csv(spark, str(tmp_path), schema), ["k"], duplicate_subset=["k"])
    assert quality.clean(read_csv(spark, str(tmp_path / "none"), schema, file_order=True), ["k"], duplicate_subset=["k"]).count() == 0
