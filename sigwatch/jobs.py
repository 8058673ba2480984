"""Whole jobs, each from input folder to output folder."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigwatch.constants import THRESHOLDS
from sigwatch.operators import metrics, quality, rebalance, training
from sigwatch.operators.actions import alert_payload
from sigwatch.operators.rules import detect
from sigwatch.operators.skew import running_count
from sigwatch.schemas import feature_table
from sigwatch.sources.captures import read_packets
from sigwatch.sources.tables import write_features, write_messages


def label_captures(spark: SparkSession, inbox: str, features_out: str, alerts_out: str,
                   batch_date: str, limit: int | None = None,
                   enrich: Callable[[DataFrame], DataFrame] | None = None,
                   addresses: DataFrame | None = None, ranges: DataFrame | None = None) -> None:
    """Capture files to labelled rows and alert messages.

    ``enrich`` may add what a packet does not tell: subscriber, nodes, other features. With
    a subscriber (``c_imsi``), messages are counted per subscriber within each file.
    """
    packets = read_packets(spark, inbox, limit)
    rows = enrich(packets) if enrich else packets
    if "c_imsi" in rows.columns:
        rows = running_count(rows, ["path", "c_imsi"], F.col("packet_no"), "packet_no",
                             "f_msg_count_per_imsi")
    labelled = detect(rows, addresses, ranges).persist()
    try:
        write_features(quality.align(labelled, feature_table()), features_out, batch_date)
        alerts = labelled.where("label = 1").select(
            alert_payload(F.col("src_ip"), F.current_timestamp(), F.col("main_threat")).alias("value"))
        write_messages(alerts, alerts_out)
    finally:
        labelled.unpersist()


def run_experiment(df: DataFrame, root: str, run_id: str, row_id: str, kind: str = "xgb",
                   parameters: Mapping[str, Any] | None = None, space: Mapping[str, Any] | None = None,
                   n_iter: int = 20, folds: int = 3, use_smote: bool = True, seed: int = 42,
                   thresholds: list[float] = THRESHOLDS, name: str = "FraudDetection_{model_type}",
                   parallelism: int = 4, patience: int = training.PATIENCE, validation: float = 0.15,
                   tags: Mapping[str, Any] | None = None) -> DataFrame:
    """Split, balance, search or fit, evaluate, log and save; returns the holdout metrics.

    Over-sampling touches training rows only; its folds hold real and synthetic rows, so
    the search score is optimistic and the holdout score is the one to trust. Without
    over-sampling, positives are weighted by how rare they are. Boosted trees hold back a slice of
    the fitted rows and stop ``patience`` rounds after their best area on it; ``validation`` 0
    turns that off. The report per class and the run's tags are logged beside its metrics.
    """
    spark = df.sparkSession
    begin = time.time()
    features = training.feature_columns(df)
    cleaned = quality.coerce_numeric(quality.clean_target(df), features)
    marked = rebalance.stratified_split(cleaned, row_id, seed=seed, exact=True)
    train_rows, holdout = marked.where("is_holdout = 0"), marked.where("is_holdout = 1")
    imputer = quality.fit_imputer(train_rows, features)  # on training rows only
    train_rows, holdout = imputer.transform(train_rows), imputer.transform(holdout)

    weight = None
    settings = {"random_state": seed, **(parameters or {})}
    if use_smote:
        fitted = rebalance.oversample(train_rows, row_id, features, seed=seed)
        fitted = fitted.withColumn("_row", F.xxhash64(*features, "label"))
    else:
        ratio = quality.class_weight(train_rows).first()["pos_weight"]
        fitted = (train_rows.withColumn("_row", F.col(row_id))
                  .withColumn("_weight", training.class_weight_column(F.col("label"), ratio)))
        weight = "_weight"
    fitted = fitted.persist()
    try:
        classifier = training.make_classifier(kind, settings, weight=weight)
        if space:
            folded = rebalance.kfold(fitted, "_row", folds=folds, seed=seed)
            search = training.random_search(folded, features, classifier, kind, space, n_iter, folds,
                                            seed=seed, parallelism=parallelism)
            results = training.search_results(spark, search)
            best = results.where("place = 1").first()
            classifier = classifier.copy(
                search.getEstimatorParamMaps()[best["draw"]])
            settings.update({f"best_{k}": v for k, v in best["parameters"].items()},
                            cv_roc_auc=best["cv_roc_auc"])
        if kind != "rf" and validation:
            sliced = rebalance.validation_flag(fitted, "_row", fraction=validation)
            model, rounds, areas = training.train_stopped(sliced, features, classifier, "is_validation", patience)
            settings.update(best_iteration=rounds, validation_roc_auc=max(areas, default=None))
        else:
            model = training.train(fitted, features, classifier)
    finally:
        fitted.unpersist()
    scored = training.score(holdout, model).persist()
    try:
        table = metrics.threshold_metrics(scored, thresholds=thresholds)
        area = metrics.roc_auc(scored).select(
            F.lit(run_id).alias("run_id"), F.lit("holdout_roc_auc_overall").alias("key"),
            F.col("roc_auc").alias("value"))
        training.log_metrics(metrics.metrics_long(table, run_id).unionByName(area), root)
        training.log_report(metrics.class_report(table), root, run_id)
        outcome = spark.createDataFrame(table.collect(), table.schema)  # one row per threshold
    finally:
        scored.unpersist()
    path = training.save_version(model, root, training.registered_name(name, kind))
    training.log_parameters(spark, root, run_id, {
        "model_type": kind, "num_features": len(features), "smote_applied": use_smote,
        "model_path": path, "seconds": round(time.time() - begin, 3), **settings})
    training.log_tags(spark, root, run_id, {"training_status": "success", "model_type": kind, **(tags or {})})
    return outcome
