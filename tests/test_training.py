import random

import pytest
from pyspark.sql import Observation, functions as F

from sigwatch.operators import metrics, rebalance, training
from sigwatch.operators.quality import MissingColumns

FEATURES = ["f_a", "f_b", "f_c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        a, b, c = rng.random(), rng.random(), rng.random()
        label = int(a + b > 1.35) if rng.random() > 0.03 else int(rng.random() < 0.5)
        data.append((i, a, None if i % 50 == 0 else b, c, label))
    frame = spark.createDataFrame(data, "id long, f_a double, f_b double, f_c double, label int")
    return rebalance.stratified_split(frame, "id").cache()


def area(model, rows):
    scored = training.score(rows.where("is_holdout = 1"), model)
    return metrics.roc_auc(scored).first()[0]


@pytest.mark.parametrize("kind,settings", [
    ("rf", {"n_estimators": 20, "max_depth": None, "min_samples_leaf": 3, "random_state": 1, "oob_score": True}),
    ("lgbm", {"n_estimators": 8, "max_depth": -1, "num_leaves": 31, "random_state": 1})])
def test_models_reach_a_floor(rows, kind, settings):
    if kind == "lgbm":
        settings = {**settings, "max_depth": 4}
    model = training.train(rows.where("is_holdout = 0"), FEATURES, training.make_classifier(kind, settings))
    assert area(model, rows) > 0.85
    assert training.model_features(model) == FEATURES


def test_parameter_names():
    assert training.spark_parameters("xgb", {"n_estimators": 5, "learning_rate": 0.1, "tree_method": "hist",
                                             "gamma": None, "max_depth": 99}) == {
        "maxIter": 5, "stepSize": 0.1, "maxDepth": 30}
    assert training.spark_parameters("rf", {"max_depth": None}) == {"maxDepth": 30}
    assert training.spark_parameters("rf", {"max_depth": -1}) == {"maxDepth": 30}
    with pytest.raises(ValueError):
        training.make_classifier("svm", {})


def test_early_stopping_keeps_fewer_trees(rows):
    flagged = rebalance.validation_flag(rows, "id").withColumn("is_validation", F.col("is_validation") == 1)
    classifier = training.make_classifier(
        "xgb", {"n_estimators": 25, "learning_rate": 0.9, "max_depth": 5, "random_state": 1},
        validation="is_validation")
    model = training.train(flagged.where("is_holdout = 0"), FEATURES, classifier)
    assert 1 <= training.best_iteration(model) < 25


def test_weights(rows):
    weighted = rows.withColumn("w", training.class_weight_column(F.col("label"), 5.0))
    classifier = training.make_classifier("rf", {"n_estimators": 5, "random_state": 1}, weight="w")
    model = training.train(weighted.where("is_holdout = 0"), FEATURES, classifier)
    plain = training.train(rows.where("is_holdout = 0"), FEATURES,
                           training.make_classifier("rf", {"n_estimators": 5, "random_state": 1}))
    mean = lambda m: training.score(rows, m).agg(F.avg("score")).first()[0]
    assert mean(model) > mean(plain)


def test_draws():
    space = {"n": training.IntRange(3, 5), "u": training.Uniform(0.6, 0.4), "c": ["hist", "auto"]}
    draws = training.draw_parameters(space, 200, 42)
    assert draws == training.draw_parameters(space, 200, 42)
    assert {d["n"] for d in draws} == {3, 4} and {d["c"] for d in draws} == {"hist", "auto"}
    assert all(0.6 <= d["u"] < 1.0 for d in draws)


def test_models_work_after_metrics_were_observed(spark, rows):
    seen = Observation("before")
    rows.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 600
    model = training.train(rows.where("is_holdout = 0"), FEATURES,
                           training.make_classifier("rf", {"n_estimators": 3, "random_state": 1}))
    assert area(model, rows) > 0.7


def test_random_search(spark, rows):
    folded = rebalance.kfold(rows.where("is_holdout = 0"), "id")
    search = training.random_search(folded, FEATURES, training.make_classifier("rf", {"random_state": 1}), "rf",
                                    {"n_estimators": training.IntRange(2, 6), "max_depth": [2, 5]}, n_iter=2)
    results = training.search_results(spark, search).orderBy("place").collect()
    assert [r["place"] for r in results] == [1, 2]
    assert results[0]["cv_roc_auc"] >= results[1]["cv_roc_auc"] > 0.7


def test_save_versions_and_score_again(spark, rows, tmp_path):
    model = training.train(rows, FEATURES, training.make_classifier("rf", {"n_estimators": 3, "random_state": 1}))
    name = training.registered_name("Fraud {model_type}/v5", "xgb")
    assert name == "Fraud_XGB-v5"
    paths = [training.save_version(model, str(tmp_path), name) for _ in range(2)]
    assert [p[-1] for p in paths] == ["1", "2"]
    assert spark.read.parquet(f"{tmp_path}/models").count() == 2
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(paths[1])
    assert area(again, rows) == pytest.approx(area(model, rows), abs=1e-12)
    with pytest.raises(MissingColumns):
        training.score(rows.drop("f_b"), again)


def test_run_log(spark, rows, tmp_path):
    scored = rows.withColumn("score", F.col("f_a"))
    training.log_metrics(metrics.metrics_long(metrics.threshold_metrics(scored), "r1"), str(tmp_path))
    training.log_parameters(spark, str(tmp_path), "r1", {"model_type": "xgb", "depth": None})
    training.log_parameters(spark, str(tmp_path), "r2", {"model_type": "rf"})
    summary = training.run_summary(spark, str(tmp_path), "r1")
    assert summary.where("kind = 'metric'").count() == 64
    assert {(r["key"], r["value"]) for r in summary.where("kind = 'param'").collect()} == {
        ("model_type", "xgb"), ("depth", None)}


def test_splits_are_disjoint_whole_and_repeatable(spark, rows):
    frame = spark.range(5000).withColumn("label", (F.col("id") % 9 == 0).cast("int"))
    once = {tuple(r) for r in rebalance.stratified_split(frame, "id").collect()}
    assert once == {tuple(r) for r in rebalance.stratified_split(frame.repartition(7), "id").collect()}
    share = sum(r[2] for r in once) / 5000
    assert len(once) == 5000 and 0.17 < share < 0.23
    tiny = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id long, label int")
    assert rebalance.stratified_split(tiny, "id", exact=True).where("is_holdout = 1").count() == 1
    assert rebalance.smote_counts(frame).where("n_after = 4444").count() == 2


def test_models_do_not_depend_on_input_parts(rows):
    classifier = training.make_classifier("rf", {"n_estimators": 10, "max_depth": 4, "random_state": 1})
    found = []
    for parts in (1, 8):
        model = training.train(rows.where("is_holdout = 0").repartition(parts), FEATURES, classifier)
        found.append({r["id"]: r["score"] for r in training.score(rows, model).collect()})
    assert found[0] == found[1]


def test_scores_that_are_no_numbers_rank_nowhere(spark):
    frame = spark.createDataFrame([(0.9, 1), (0.1, 0), (None, 0), (float("nan"), 0)], "score double, label int")
    assert metrics.roc_auc(frame).first()[0] == 1.0
    assert {(r["tp"], r["fp"]) for r in metrics.roc_points(frame).collect()} == {(1, 0), (1, 1)}
    assert {r["support_0"] for r in metrics.threshold_metrics(frame).collect()} == {1}


def test_early_stopping_on_the_area_of_a_slice(spark):
    import random

    from sigwatch.operators import metrics
    draw = random.Random(3)
    rows = []
    for i in range(600):
        a, b = draw.random(), draw.random()
        rows.append((i, a, b, int((a + 0.3 * draw.random() > 0.7) != (draw.random() < 0.15)), int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "id long, f_a double, f_b double, label int, held int")
    classifier = training.make_classifier("xgb", {"n_estimators": 25, "max_depth": 3, "random_state": 1})
    model, rounds, areas = training.train_stopped(frame, ["f_a", "f_b"], classifier, "held", patience=5)
    assert len(areas) == 25 and 1 <= rounds == model.stages[-1].getNumTrees < 25
    # Every stage against plain counting of pairs.
    full = training.train(frame.where("held = 0"), ["f_a", "f_b"], classifier)
    by_stage = {}
    for r in training.staged_margins(frame.where("held = 1"), full).collect():
        by_stage.setdefault(r.stage, ([], []))[r.label].append(r.score)
    plain = [sum((p > n) + (p == n) / 2 for p in ones for n in zeros) / (len(ones) * len(zeros))
             for _, (zeros, ones) in sorted(by_stage.items())]
    assert areas == pytest.approx(plain, abs=1e-12)
    before = areas[:rounds]
    assert before[-1] == max(before) and max(areas[rounds:rounds + 5]) <= before[-1]
    # The short model scores as the long one did at that round.
    last = {round(r.score, 9) for r in training.staged_margins(frame, full).where(F.col("stage") == rounds).collect()}
    short = {round(r.score, 9) for r in training.staged_margins(frame, model).where(F.col("stage") == rounds).collect()}
    assert last == short
    area = metrics.roc_auc(training.score(frame.where("held = 1"), model)).first()[0]
    assert area == pytest.approx(areas[rounds - 1], abs=1e-9)
    same = metrics.staged_auc(training.staged_margins(frame.where("held = 1"), full), target_rows=40).orderBy("stage").collect()
    assert [r.roc_auc for r in same] == pytest.approx(areas, abs=1e-12)
    one_class = frame.withColumn("label", F.when(F.col("held") == 1, 1).otherwise(F.col("label")))
    assert training.train_stopped(one_class, ["f_a", "f_b"], classifier, "held")[1:] == (25, [])


def test_patience():
    assert training.stopping_round([0.5, 0.7, 0.6, 0.6, 0.6, 0.9], 3) == 2
    assert training.stopping_round([0.5, 0.7, 0.6, 0.6, 0.9], 3) == 5
    assert training.stopping_round([], 3) == 0
