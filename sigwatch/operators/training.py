"""Training, search, scoring and the run log on Spark ML."""

from __future__ import annotations

import random
import re
from collections.abc import Mapping
from typing import Any

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigwatch.operators import metrics
from sigwatch.operators.quality import require_columns, with_prefix

# Parameter names accepted per model kind and the Spark ML parameter each one sets.
_FOREST = {
    "n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
    "min_impurity_decrease": "minInfoGain", "max_samples": "subsamplingRate",
    "max_features": "featureSubsetStrategy", "criterion": "impurity", "random_state": "seed",
    "bootstrap": "bootstrap",
}
_BOOSTED = {
    "n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth",
    "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
    "gamma": "minInfoGain", "max_bin": "maxBins", "random_state": "seed",
}
_LEAFWISE = {
    "n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth",
    "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
    "min_split_gain": "minInfoGain", "min_child_samples": "minInstancesPerNode",
    "random_state": "seed",
}
PARAMETERS = {"rf": _FOREST, "xgb": _BOOSTED, "lgbm": _LEAFWISE}
_DEEPEST = 30  # deepest tree Spark ML builds


def spark_parameters(kind: str, parameters: Mapping[str, Any]) -> dict[str, Any]:
    """Known parameters under their Spark ML names; unknown and empty ones are dropped."""
    known = PARAMETERS[kind]
    given = {k: v for k, v in parameters.items() if k in known and v is not None}
    out = {known[k]: v for k, v in given.items()}
    if "maxDepth" in out:
        out["maxDepth"] = _DEEPEST if out["maxDepth"] < 0 else min(out["maxDepth"], _DEEPEST)
    elif kind == "rf" and "max_depth" in parameters:
        out["maxDepth"] = _DEEPEST
    if "featureSubsetStrategy" in out:
        out["featureSubsetStrategy"] = str(out["featureSubsetStrategy"])
    return out


class Forest(RandomForestClassifier):
    """Forest whose model leaves its training summary behind.

    The summary holds the session, and a session that has observed metrics cannot be sent
    to tasks, so scoring with the summary attached would fail. Copies carry none.
    """

    def _fit(self, dataset: DataFrame):
        return super()._fit(dataset).copy()


def make_classifier(kind: str, parameters: Mapping[str, Any], features: str = "features",
                    label: str = "label", weight: str | None = None,
                    validation: str | None = None):
    """Untrained classifier: ``rf`` as a random forest, ``xgb`` and ``lgbm`` as boosted trees.

    ``weight`` names a row-weight column; leave it out when classes were equalised.
    ``validation`` names a boolean column of early-stopping rows (boosted trees only).
    """
    if kind not in PARAMETERS:
        raise ValueError(f"unknown model kind: {kind}")
    settings = spark_parameters(kind, parameters)
    common = {"featuresCol": features, "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if kind == "rf":
        return Forest(**common, **settings)
    model = GBTClassifier(**common, **settings)
    return model.setValidationIndicatorCol(validation) if validation else model


def class_weight_column(label: Column, positive_weight: float) -> Column:
    return F.when(label == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))


def assemble(features: list[str], impute: bool = True, on_invalid: str = "keep") -> list:
    """Mean imputation and vector assembly as stages; a bad row does not stop the job."""
    stages: list = []
    if impute:
        stages.append(Imputer(strategy="mean", inputCols=features, outputCols=features))
    stages.append(VectorAssembler(inputCols=features, outputCol="features",
                                  handleInvalid=on_invalid))
    return stages


#: Parts of the training rows. Forests draw their samples part by part, so this number, not the
#: cluster or the input files, decides a model; raise it with the data.
PARTS = 16


def keep_spread(df: DataFrame, parts: int = PARTS) -> DataFrame:
    """Persist the rows in ``parts`` parts dealt and ordered by their content alone."""
    content = F.xxhash64(*df.columns)
    return df.repartition(parts, content).sortWithinPartitions(content).persist()


def train(df: DataFrame, features: list[str], classifier) -> PipelineModel:
    """Impute, assemble and fit; all passes share one kept copy of the input columns."""
    require_columns(df, features)
    used = [classifier.getLabelCol()] + [
        classifier.getOrDefault(p) for p in ("weightCol", "validationIndicatorCol")
        if classifier.hasParam(p) and classifier.isSet(p)]
    kept = keep_spread(df.select(*features, *used))
    try:
        prepared = Pipeline(stages=assemble(features)).fit(kept)
        fitted = classifier.fit(prepared.transform(kept).select("features", *used))
        return PipelineModel(stages=[*prepared.stages, fitted])
    finally:
        kept.unpersist()


def best_iteration(model: PipelineModel) -> int:
    """Trees kept by the final model, after early stopping."""
    return model.stages[-1].getNumTrees


PATIENCE = 10


def staged_margins(df: DataFrame, model: PipelineModel, label: str = "label") -> DataFrame:
    """One row per row and boosting round: stage (from 1), label, score (the margin up to it)."""
    rows = PipelineModel(stages=model.stages[:-1]).transform(df).select("features", label)
    fitted = model.stages[-1]
    names = [f"_tree{i}" for i in range(len(fitted.trees))]
    for tree, name in zip(fitted.trees, names):
        rows = tree.copy({tree.predictionCol: name}).transform(rows)
    steps = F.array(*[F.col(name) * float(w) for name, w in zip(names, fitted.treeWeights)])
    margins = F.aggregate(steps, F.array().cast("array<double>"), lambda sums, step: F.array_append(
        sums, step + F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0))))
    return rows.select(label, F.posexplode(margins).alias("stage", "score")).select(
        (F.col("stage") + 1).alias("stage"), label, "score")


def stopping_round(areas: list[float], patience: int = PATIENCE) -> int:
    """The best round met before ``patience`` rounds in a row brought nothing better."""
    best, at = float("-inf"), 0
    for n, area in enumerate(areas, 1):
        if area > best:
            best, at = area, n
        elif n - at >= patience:
            break
    return at


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model as it was after so many rounds."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    short = GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        model.uid, trees, weights))
    model._copyValues(short)
    short._transfer_params_to_java()
    return short


def train_stopped(df: DataFrame, features: list[str], classifier, validation: str,
                  patience: int = PATIENCE) -> tuple[PipelineModel, int, list[float]]:
    """Fit boosted trees without the rows that ``validation`` marks, and keep the rounds up to the
    one with the best area under the ROC curve on them. Returns the model, its rounds, and the
    areas of all rounds. Without both classes among the marked rows all rounds stay."""
    held = F.coalesce(F.col(validation).cast("boolean"), F.lit(False))
    model = train(df.where(~held), features, classifier)
    label = classifier.getLabelCol()
    # One number per boosting round.
    rows = metrics.staged_auc(staged_margins(df.where(held), model, label), label=label).orderBy("stage").collect()
    areas = [r["roc_auc"] for r in rows]
    if not areas or None in areas:
        return model, model.stages[-1].getNumTrees, []
    rounds = stopping_round(areas, patience)
    return PipelineModel(stages=[*model.stages[:-1], first_rounds(model.stages[-1], rounds)]), rounds, areas


class Uniform:
    """Real numbers in [start, start + width)."""

    def __init__(self, start: float, width: float):
        self.start, self.width = start, width

    def draw(self, rng: random.Random) -> float:
        return self.start + rng.random() * self.width


class IntRange:
    """Whole numbers from low to high - 1."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def draw(self, rng: random.Random) -> int:
        return rng.randrange(self.low, self.high)


def draw_parameters(space: Mapping[str, Any], n: int, seed: int) -> list[dict[str, Any]]:
    """``n`` seeded draws; lists stand for a choice among their items."""
    rng = random.Random(seed)
    names = sorted(space)
    return [{k: space[k].draw(rng) if hasattr(space[k], "draw") else rng.choice(space[k])
             for k in names} for _ in range(n)]


def random_search(df: DataFrame, features: list[str], classifier, kind: str,
                  space: Mapping[str, Any], n_iter: int = 20, folds: int = 3,
                  fold_column: str = "fold", seed: int = 42,
                  parallelism: int = 4) -> CrossValidatorModel:
    """Cross-validated search by area under the ROC curve; the best draw is fitted again.

    Input columns are kept once; all draws and folds read that copy.
    """
    label = classifier.getLabelCol()
    used = [label, fold_column]
    if classifier.isSet("weightCol"):
        used.append(classifier.getWeightCol())
    kept = keep_spread(df.select(*features, *used))
    try:
        prepared = (Pipeline(stages=assemble(features)).fit(kept).transform(kept)
                    .select("features", *used))
        maps = [{classifier.getParam(k): v for k, v in spark_parameters(kind, d).items()}
                for d in draw_parameters(space, n_iter, seed)]
        search = CrossValidator(
            estimator=classifier, estimatorParamMaps=maps, numFolds=folds, foldCol=fold_column,
            evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
            parallelism=parallelism)
        return search.fit(prepared)
    finally:
        kept.unpersist()


def search_results(spark: SparkSession, search: CrossValidatorModel) -> DataFrame:
    """Mean score per draw with its parameters, best first by rank."""
    order = sorted(range(len(search.avgMetrics)), key=lambda i: (-search.avgMetrics[i], i))
    place = {i: r + 1 for r, i in enumerate(order)}
    rows = [(i, place[i], float(score), {p.name: str(v) for p, v in params.items()})
            for i, (score, params) in enumerate(
                zip(search.avgMetrics, search.getEstimatorParamMaps()))]
    return spark.createDataFrame(
        rows, "draw int, place int, cv_roc_auc double, parameters map<string,string>")


def positive_probability(probability: str = "probability") -> Column:
    return vector_to_array(F.col(probability))[1]


def score(df: DataFrame, model: PipelineModel, name: str = "score") -> DataFrame:
    """Score all rows in one pass, with the columns saved in the model."""
    require_columns(df, model_features(model))
    kept = df.columns
    return model.transform(df).select(*kept, positive_probability().alias(name))


def model_features(model: PipelineModel) -> list[str]:
    """Input columns of the saved model, in order."""
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return list(stage.getInputCols())
    raise ValueError("model has no assembled features")


def feature_columns(df: DataFrame) -> list[str]:
    names = with_prefix(df, "f_")
    if not names:
        raise ValueError("no feature columns (f_*)")
    return names


def registered_name(experiment: str, kind: str) -> str:
    """Name under which a model is kept; the template field takes the model kind."""
    name = experiment.replace("{model_type}", kind.upper())
    return re.sub(r"[/\\]", "-", name.replace(" ", "_"))


def save_version(model: PipelineModel, root: str, name: str) -> str:
    """Save under the next free version and note it in the ``models`` table."""
    spark = SparkSession.getActiveSession()
    table = f"{root}/models"
    try:
        last = (spark.read.parquet(table).where(F.col("name") == name)
                .agg(F.max("version")).first()[0] or 0)
    except Exception as missing:  # first model: no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        last = 0
    path = f"{root}/{name}/version={last + 1}"
    model.write().save(path)
    row = spark.createDataFrame([(name, last + 1, path)], "name string, version int, path string")
    row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(table)
    return path


def log_parameters(spark: SparkSession, root: str, run_id: str, parameters: Mapping[str, Any]) -> None:
    rows = [(run_id, k, None if v is None else str(v)) for k, v in parameters.items()]
    (spark.createDataFrame(rows, "run_id string, key string, value string").coalesce(1)
     .write.mode("append").parquet(f"{root}/run_params"))


def log_tags(spark: SparkSession, root: str, run_id: str, tags: Mapping[str, Any]) -> None:
    rows = [(run_id, k, str(v)) for k, v in tags.items()]
    (spark.createDataFrame(rows, "run_id string, key string, value string").coalesce(1)
     .write.mode("append").parquet(f"{root}/run_tags"))


def log_report(report: DataFrame, root: str, run_id: str) -> None:
    """Append the report per class and threshold."""
    report.withColumn("run_id", F.lit(run_id)).coalesce(1).write.mode("append").parquet(f"{root}/run_reports")


def log_metrics(table: DataFrame, root: str) -> None:
    """Append long-form metrics (run_id, key, value)."""
    table.coalesce(1).write.mode("append").parquet(f"{root}/run_metrics")


def run_summary(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Everything logged for one run."""
    def of(table: str, kind: str) -> DataFrame:
        return (spark.read.parquet(f"{root}/{table}").where(F.col("run_id") == run_id)
                .select(F.lit(kind).alias("kind"), "key", F.col("value").cast("string")))
    return of("run_params", "param").unionByName(of("run_metrics", "metric"))
