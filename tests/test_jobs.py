import json
import random

from pyspark.sql import functions as F

from sigwatch import jobs
from sigwatch.operators import training
from tests.test_sources import V4, classic, ethernet, ipv4


def test_captures_to_labels_and_alerts(spark, tmp_path):
    bad = bytes.fromhex("a10302010102011630")
    packets = [ethernet(V4, ipv4([45, 148, 10, 84]) + bad), ethernet(V4, ipv4([10, 0, 0, 1]))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pcap").write_bytes(classic(packets))
    jobs.label_captures(spark, str(tmp_path / "in"), str(tmp_path / "f"), str(tmp_path / "a"), "2024-01-01")
    rows = {r["src_ip"]: r["label"] for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    # No subscriber id: integrity (2) alone, with signature (2) and list (1) anomalous.
    assert rows == {"45.148.10.84": 1, "10.0.0.1": 0}
    alerts = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert [(a["ip"], a["amenaza"]) for a in alerts] == [("45.148.10.84", "Integridad de datos sospechosa")]


def test_messages_are_counted_per_subscriber_and_file(spark, tmp_path):
    packets = [ethernet(V4, ipv4([10, 0, 0, 1]))] * 52
    (tmp_path / "in").mkdir()
    for name in ("x.pcap", "y.pcap"):
        (tmp_path / "in" / name).write_bytes(classic(packets))
    jobs.label_captures(spark, str(tmp_path / "in"), str(tmp_path / "f"), str(tmp_path / "a"), "2024-01-01",
                        enrich=lambda p: p.withColumn("c_imsi", F.lit("242011111111100")))
    rows = spark.read.parquet(str(tmp_path / "f"))
    assert rows.agg(F.max("f_msg_count_per_imsi")).first()[0] == 52
    assert rows.where("label = 1").count() == 4


def test_experiment(spark, tmp_path):
    rng = random.Random(4)
    data = []
    for i in range(400):
        a, b = rng.random(), rng.random()
        data.append((i, str(a) if i % 40 else "n/a", b, None if i % 97 == 0 else int(a + 0.2 * b > 0.85)))
    frame = spark.createDataFrame(data, "id long, f_a string, f_b double, label int")
    space = {"n_estimators": training.IntRange(3, 8), "max_depth": [2, 4]}
    for run_id, options in (("r1", {"space": space, "n_iter": 2}), ("r2", {"use_smote": False})):
        got = jobs.run_experiment(frame, str(tmp_path), run_id, "id", "rf",
                                  {"n_estimators": 8, "max_depth": 4}, **options)
        best = got.where("threshold = 0.5").first()
        assert best["accuracy"] > 0.85 and best["tp"] + best["fn"] > 5
        summary = {r["key"]: r["value"] for r in training.run_summary(spark, str(tmp_path), run_id).collect()}
        assert float(summary["holdout_roc_auc_overall"]) > 0.9
        assert summary["smote_applied"] == str(run_id == "r1")
    assert "best_maxDepth" in {r["key"] for r in training.run_summary(spark, str(tmp_path), "r1").collect()}
    assert spark.read.parquet(f"{tmp_path}/models").count() == 2
    jobs.run_experiment(frame, str(tmp_path), "r3", "id", "xgb", {"n_estimators": 12, "max_depth": 2}, patience=3,
                        tags={"owner": "tests"})
    summary = {r["key"]: r["value"] for r in training.run_summary(spark, str(tmp_path), "r3").collect()}
    assert 1 <= int(summary["best_iteration"]) <= 12 and 0.5 < float(summary["validation_roc_auc"]) <= 1
    reports = spark.read.parquet(f"{tmp_path}/run_reports")
    assert {r.run_id: r.n for r in reports.groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {"r1": 20, "r2": 20, "r3": 20}
    tags = spark.read.parquet(f"{tmp_path}/run_tags").where("run_id = 'r3'").collect()
    assert {(t["key"], t["value"]) for t in tags} == {("training_status", "success"), ("model_type", "xgb"), ("owner", "tests")}
