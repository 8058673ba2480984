"""Classifier evaluation, splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigwatch.constants import THRESHOLDS
from sigwatch.operators import metrics, rebalance, training
from sigwatch.plans.registry import query
from sigwatch.plans.views import SCORED, scored_events, table

_R = "CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _ratio(a: str, b: str) -> str:
    return _R.format(a=a, b=b)


_METRICS = f"""{SCORED}, counts AS (SELECT threshold,
 count(*) FILTER (label = 1 AND score >= threshold) AS tp,
 count(*) FILTER (label = 0 AND score < threshold) AS tn,
 count(*) FILTER (label = 0 AND score >= threshold) AS fp,
 count(*) FILTER (label = 1 AND score < threshold) AS fn
 FROM scored, (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in THRESHOLDS)}]) AS threshold)
 GROUP BY threshold),
per_class AS (SELECT *, tn + fp AS support_0, tp + fn AS support_1,
 {_ratio('(tp + tn)', '(tp + tn + fp + fn)')} AS accuracy,
 {_ratio('tn', '(tn + fn)')} AS precision_0, {_ratio('tn', '(tn + fp)')} AS recall_0,
 {_ratio('2 * tn', '(2 * tn + fp + fn)')} AS f1_0,
 {_ratio('tp', '(tp + fp)')} AS precision_1, {_ratio('tp', '(tp + fn)')} AS recall_1,
 {_ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1_1 FROM counts),
metrics AS (SELECT *, (precision_0 + precision_1) / 2 AS precision_macro,
 (recall_0 + recall_1) / 2 AS recall_macro, (f1_0 + f1_1) / 2 AS f1_macro FROM per_class)"""
_NAMES = ", ".join(metrics.METRICS)


def _evaluated(spark, sf_dir):
    return metrics.threshold_metrics(scored_events(spark, sf_dir))


@query("threshold_metrics", f"WITH {_METRICS} SELECT threshold, {_NAMES} FROM metrics")
def threshold_metrics(spark, sf_dir):
    return _evaluated(spark, sf_dir)


def _weighted(m: str) -> str:
    return f"({m}_0 * support_0 + {m}_1 * support_1) / (support_0 + support_1)"


@query("class_report", f"""WITH {_METRICS}, lines AS (
SELECT threshold, 'Class 0' AS line, precision_0 AS precision, recall_0 AS recall, f1_0 AS f1_score,
 support_0 AS support FROM metrics
UNION ALL SELECT threshold, 'Class 1', precision_1, recall_1, f1_1, support_1 FROM metrics
UNION ALL SELECT threshold, 'accuracy', NULL, NULL, accuracy, support_0 + support_1 FROM metrics
UNION ALL SELECT threshold, 'macro avg', precision_macro, recall_macro, f1_macro,
 support_0 + support_1 FROM metrics
UNION ALL SELECT threshold, 'weighted avg', {_weighted('precision')}, {_weighted('recall')},
 {_weighted('f1')}, support_0 + support_1 FROM metrics)
SELECT threshold, line, round(precision, 9) AS precision, round(recall, 9) AS recall,
 round(f1_score, 9) AS f1_score, support FROM lines""")
def class_report(spark, sf_dir):
    report = metrics.class_report(_evaluated(spark, sf_dir))
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1_score")})


@query("default_threshold", f"""WITH {_METRICS} SELECT threshold, {_NAMES} FROM metrics
ORDER BY CASE WHEN threshold = 0.5 THEN 0 ELSE 1 END, threshold LIMIT 1""")
def default_threshold(spark, sf_dir):
    return metrics.default_metrics(_evaluated(spark, sf_dir))


@query("run_metrics_long", f"""WITH {_METRICS} SELECT 'run-1' AS run_id, key, value FROM (""" + " UNION ALL ".join(
    f"SELECT printf('th_%.2f_{m}', threshold) AS key, CAST({m} AS DOUBLE) AS value FROM metrics"
    for m in metrics.METRICS) + ")")
def run_metrics_long(spark, sf_dir):
    return metrics.metrics_long(_evaluated(spark, sf_dir), "run-1")


_ROC = f"""{SCORED}, by_score AS (SELECT score, count(*) FILTER (label = 1) AS p,
 count(*) FILTER (label = 0) AS n FROM scored GROUP BY score),
ranked AS (SELECT score AS threshold, p, n,
 CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
 CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM by_score)"""


@query("roc_points", f"""WITH {_ROC} SELECT threshold, tp, fp,
 CAST(tp AS DOUBLE) / (SELECT sum(p) FROM by_score) AS tpr,
 CAST(fp AS DOUBLE) / (SELECT sum(n) FROM by_score) AS fpr FROM ranked""")
def roc_points(spark, sf_dir):
    return metrics.roc_points(scored_events(spark, sf_dir))


@query("roc_auc", f"""WITH {_ROC}, points AS (SELECT 0 AS threshold, CAST(tp AS DOUBLE) AS tp,
 CAST(fp AS DOUBLE) AS fp, CAST(lag(tp, 1, 0) OVER (ORDER BY threshold DESC) AS DOUBLE) AS tp0,
 CAST(lag(fp, 1, 0) OVER (ORDER BY threshold DESC) AS DOUBLE) AS fp0 FROM ranked)
SELECT round(sum((fp - fp0) * (tp + tp0) / 2) / (max(tp) * max(fp)), 9) AS roc_auc FROM points""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored_events(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


#: Margins after each of twelve rounds: they tell the classes apart better up to the sixth.
_MARGIN = "CAST((event_id * (2 * stage + 1)) % 997 + label * (CASE WHEN stage <= 6 THEN 10 * stage ELSE 90 - 5 * stage END) AS DOUBLE)"


@query("staged_auc", f"""WITH staged AS (SELECT stage, label, {_MARGIN} AS m
 FROM (SELECT event_id, CAST(event_type = 'error' AS INT) AS label FROM events), range(1, 13) t(stage)),
g AS (SELECT stage, m, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM staged GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY stage ORDER BY m) - n / 2 AS below FROM g),
a AS (SELECT stage, sum(p * below) / (sum(p) * sum(n)) AS area FROM r GROUP BY stage),
w AS (SELECT *, area > COALESCE(max(area) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
 AND area >= COALESCE(max(area) OVER (ORDER BY stage ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), -1) AS stop FROM a)
SELECT CAST(stage AS INT) AS stage, round(area, 9) AS roc_auc,
 stage = (SELECT min(stage) FROM w WHERE stop) AS kept FROM w""")
def staged_auc(spark, sf_dir):
    """Areas of all rounds of given margins, and the round that early stopping keeps."""
    rows = scored_events(spark, sf_dir).withColumn("stage", F.explode(F.sequence(F.lit(1), F.lit(12))))
    areas = metrics.staged_auc(rows.withColumn("score", F.expr(_MARGIN)))
    # One number per round.
    kept = training.stopping_round([r["roc_auc"] for r in areas.orderBy("stage").collect()], patience=3)
    return areas.select("stage", F.round("roc_auc", 9).alias("roc_auc"), (F.col("stage") == kept).alias("kept"))


def _hash(seed: int, column: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({column} AS VARCHAR)), 1, 8) AS BIGINT)"


@query("stratified_split", f"""SELECT doc_id, toxic,
 CASE WHEN {_hash(42, 'doc_id')} < 858993459 THEN 1 ELSE 0 END AS is_holdout FROM labels""")
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return rebalance.stratified_split(rows, "doc_id", "toxic")


@query("stratified_split_exact", f"""SELECT doc_id, toxic, CASE WHEN row_number() OVER
 (PARTITION BY toxic ORDER BY {_hash(42, 'doc_id')}, doc_id)
 <= ceil(count(*) OVER (PARTITION BY toxic) * CAST(0.2 AS DOUBLE)) THEN 1 ELSE 0 END AS is_holdout FROM labels""")
def stratified_split_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return rebalance.stratified_split(rows, "doc_id", "toxic", exact=True)


@query("kfold_assign", f"""SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic
 ORDER BY {_hash(42, 'doc_id')}, doc_id) - 1) % 3 AS INT) AS fold FROM labels""")
def kfold_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return rebalance.kfold(rows, "doc_id", "toxic")


@query("validation_flag", f"""SELECT doc_id, toxic,
 CASE WHEN {_hash(43, 'doc_id')} < 644245094 THEN 1 ELSE 0 END AS is_validation FROM labels""")
def validation_flag(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return rebalance.validation_flag(rows, "doc_id")


@query("sample_k", f"""SELECT event_id, event_type, value FROM events
ORDER BY {_hash(42, 'event_id')}, event_id LIMIT 100""")
def sample_k(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rebalance.sample_rows(rows, "event_id", 100)
