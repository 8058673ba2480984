"""Over-sampling, training, search and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigwatch.constants import THRESHOLDS
from sigwatch.operators import metrics, rebalance, training
from sigwatch.plans.detection import LABELLED, labelled
from sigwatch.plans.evaluation import _hash
from sigwatch.plans.registry import query
from sigwatch.plans.views import table

FEATURES = ["f_same_cggt_is_hlr_oc", "f_count_ok_sri_between2lu", "f_frequent_ok_sri_between2lu",
            "f_count_ok_psi_between2lu", "f_count_ok_ul_between2lu"]


@query("smote_counts", """SELECT toxic, count(*) AS n_before, (SELECT max(n) FROM
 (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n_after FROM labels GROUP BY toxic""")
def smote_counts(spark, sf_dir):
    return rebalance.smote_counts(table(spark, sf_dir, "labels"), "toxic")


_MINORITY = """minority AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
 WHERE label = 0),
gaps AS (SELECT a.id, b.id AS neighbour, list_distance(a.x, b.x) AS distance
 FROM minority a JOIN minority b ON a.id <> b.id),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INT)
 AS rank FROM gaps QUALIFY rank <= 5)"""


@query("minority_neighbours", f"""WITH {_MINORITY}
SELECT id, neighbour, round(distance, 6) AS distance, rank FROM near""")
def minority_neighbours(spark, sf_dir):
    points = (table(spark, sf_dir, "embeddings").where("label = 0")
              .select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")))
    found = rebalance.nearest_neighbours(points, 5)
    return found.select("id", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query("smote_rows", f"""WITH {_MINORITY}, sizes AS (SELECT count(*) FILTER (label = 0) AS n1,
 count(*) FILTER (label <> 0) - count(*) FILTER (label = 0) AS missing FROM embeddings),
turns AS (SELECT id, row_number() OVER (ORDER BY {_hash(42, 'id')}, id) AS turn FROM minority),
due AS (SELECT id, missing // n1 + CASE WHEN turn <= missing % n1 THEN 1 ELSE 0 END AS copies
 FROM turns, sizes),
copies AS (SELECT id, unnest(range(1, copies + 1)) AS copy FROM due),
drawn AS (SELECT id, copy, CAST('0x' || substr(md5(concat_ws(':', 42, id, copy)), 1, 8) AS BIGINT)
 % 5 + 1 AS rank, CAST('0x' || substr(md5(concat_ws(':', 42, id, copy)), 9, 8) AS BIGINT)
 / CAST(4294967296 AS DOUBLE) AS u FROM copies)
SELECT d.id AS base, n.neighbour, CAST(d.copy AS INT) AS copy, round(d.u, 9) AS u,
 array_to_string(list_transform(range(1, len(a.x) + 1),
  lambda i: CAST(round(1000000 * (a.x[i] + d.u * (b.x[i] - a.x[i]))) AS BIGINT)), ',') AS millionths
FROM drawn d JOIN near n ON n.id = d.id AND n.rank = d.rank
JOIN minority a ON a.id = d.id JOIN minority b ON b.id = n.neighbour""")
def smote_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))
    made = rebalance.smote_rows(rows, "vec_id", "embedding")
    return made.select("base", "neighbour", F.col("copy").cast("int").alias("copy"),
                       F.round("u", 9).alias("u"),
                       F.array_join(F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")),
                                    ",").alias("millionths"))


def _labelled(spark, sf_dir):
    """Features with the rule label and the holdout mark."""
    rows = labelled(spark, sf_dir).select("event_id", *FEATURES, "label")
    return rebalance.stratified_split(rows, "event_id")


_HELD = f"CASE WHEN {_hash(42, 'event_id')} < 858993459 THEN 1 ELSE 0 END"
_SUPPORT = f"""WITH {LABELLED}, thresholds AS (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in THRESHOLDS)}])
 AS threshold), held AS (SELECT label FROM labelled WHERE {_HELD} = 1)
SELECT threshold, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
 TRUE AS learnt FROM thresholds, held GROUP BY threshold"""


def _evaluate(rows, classifier):
    """Support per threshold, and whether the model beats any constant answer (at most 0.5)."""
    model = training.train(rows.where("is_holdout = 0"), FEATURES, classifier)
    found = metrics.threshold_metrics(training.score(rows.where("is_holdout = 1"), model))
    return found.select("threshold", F.col("support_1").alias("positives"),
                        F.col("support_0").alias("negatives"), (F.col("f1_macro") > 0.5).alias("learnt"))


@query("train_rf", _SUPPORT)
def train_rf(spark, sf_dir):
    """Random forest, held against the holdout rows."""
    settings = {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 5, "random_state": 42}
    return _evaluate(_labelled(spark, sf_dir), training.make_classifier("rf", settings))


@query("train_gbt", _SUPPORT)
def train_gbt(spark, sf_dir):
    """Boosted trees with early stopping on a validation slice."""
    rows = rebalance.validation_flag(_labelled(spark, sf_dir), "event_id")
    rows = rows.withColumn("is_validation", F.col("is_validation") == 1)
    settings = {"n_estimators": 15, "learning_rate": 0.1, "max_depth": 5, "subsample": 0.8,
                "colsample_bytree": 0.8, "random_state": 42}
    return _evaluate(rows, training.make_classifier("xgb", settings, validation="is_validation"))


@query("random_search", """SELECT CAST(d AS INT) AS draw, 3 AS parameters, TRUE AS scored,
 d = 0 AS counted FROM range(4) t(d)""")
def random_search(spark, sf_dir):
    """Seeded random search with stratified folds, scored by area under the ROC curve."""
    rows = _labelled(spark, sf_dir).where("is_holdout = 0")
    folded = rebalance.kfold(rows, "event_id")
    space = {"n_estimators": training.IntRange(5, 15), "max_depth": training.IntRange(3, 8),
             "min_samples_leaf": training.IntRange(1, 20)}
    search = training.random_search(
        folded, FEATURES, training.make_classifier("rf", {"random_state": 42}), "rf", space,
        n_iter=4, parallelism=8)
    results = training.search_results(spark, search)
    places = results.agg(F.sort_array(F.collect_list("place"))).first()[0]  # one number per draw
    return results.select("draw", F.size("parameters").alias("parameters"),
                          F.col("cv_roc_auc").between(0.7, 1.0).alias("scored"),
                          (F.lit(places == [1, 2, 3, 4]) & (F.col("draw") == 0)).alias("counted"))


@query("score_rows", f"""WITH {LABELLED} SELECT event_id, TRUE AS scored FROM labelled WHERE label = 1""")
def score_rows(spark, sf_dir):
    """Score all anomalous rows with a trained forest."""
    rows = _labelled(spark, sf_dir)
    settings = {"n_estimators": 100, "max_depth": 6, "random_state": 42}
    model = training.train(rows.where("is_holdout = 0"), FEATURES,
                           training.make_classifier("rf", settings))
    return training.score(rows.where("label = 1").select("event_id", *FEATURES), model).select(
        "event_id", F.col("score").between(0.0, 1.0).alias("scored"))
