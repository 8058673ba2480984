"""Classifier evaluation in single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sigwatch.constants import DEFAULT_THRESHOLD, THRESHOLDS
from sigwatch.operators.skew import TARGET_ROWS, light_slicing, running_sums

METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro",
           "precision_0", "recall_0", "f1_0", "support_0",
           "precision_1", "recall_1", "f1_1", "support_1", "tp", "tn", "fp", "fn"]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def confusion_counts(df: DataFrame, label: str, score: str,
                     thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """tp, fp, tn, fn per threshold; rows are read once and never repeated."""
    is_one, value = F.col(label) == 1, F.col(score)
    sums = [F.count_if(is_one).alias("_ones"), F.count_if(F.col(label) == 0).alias("_zeros")]
    for i, t in enumerate(thresholds):
        sums.append(F.count_if(is_one & (value >= t)).alias(f"_tp{i}"))
        sums.append(F.count_if((F.col(label) == 0) & (value >= t)).alias(f"_fp{i}"))
    lines = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"),
                 F.col(f"_tp{i}").alias("tp"), (F.col("_zeros") - F.col(f"_fp{i}")).alias("tn"),
                 F.col(f"_fp{i}").alias("fp"), (F.col("_ones") - F.col(f"_tp{i}")).alias("fn"))
        for i, t in enumerate(thresholds)])
    return scored_rows(df, score).agg(*sums).select(F.explode(lines).alias("l")).select("l.*")


def threshold_metrics(df: DataFrame, label: str = "label", score: str = "score",
                      thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """The sixteen holdout metrics per threshold; undefined ratios are 0."""
    counts = confusion_counts(df, label, score, thresholds)
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    base = counts.withColumns({
        "support_0": F.col("tn") + F.col("fp"), "support_1": F.col("tp") + F.col("fn"),
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision_0": _ratio(tn, tn + fn), "recall_0": _ratio(tn, tn + fp),
        "f1_0": _ratio(2 * tn, 2 * tn + fp + fn),
        "precision_1": _ratio(tp, tp + fp), "recall_1": _ratio(tp, tp + fn),
        "f1_1": _ratio(2 * tp, 2 * tp + fp + fn)})
    macro = {f"{m}_macro": (F.col(f"{m}_0") + F.col(f"{m}_1")) / 2
             for m in ("precision", "recall", "f1")}
    return base.withColumns(macro).select("threshold", *METRICS)


def class_report(metrics: DataFrame) -> DataFrame:
    """Per-threshold report lines: both classes, accuracy, macro and weighted averages."""
    total = F.col("support_0") + F.col("support_1")

    def weighted(name: str) -> Column:
        top = (F.col(f"{name}_0") * F.col("support_0") + F.col(f"{name}_1") * F.col("support_1"))
        return _ratio(top, total)

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("line"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1_score"), support.alias("support"))

    nothing = F.lit(None).cast("double")
    lines = F.array(
        line("Class 0", *map(F.col, ("precision_0", "recall_0", "f1_0", "support_0"))),
        line("Class 1", *map(F.col, ("precision_1", "recall_1", "f1_1", "support_1"))),
        line("accuracy", nothing, nothing, F.col("accuracy"), total),
        line("macro avg", *map(F.col, ("precision_macro", "recall_macro", "f1_macro")), total),
        line("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), total))
    return metrics.select("threshold", F.explode(lines).alias("l")).select("threshold", "l.*")


def scored_rows(df: DataFrame, score: str) -> DataFrame:
    """Rows whose score is a number; null and NaN rank nowhere."""
    return df.where(F.col(score).isNotNull() & ~F.isnan(score))


def _scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows per distinct score; tied rows collapse before any ordering."""
    return scored_rows(df, score).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score",
               target_rows: float = TARGET_ROWS) -> DataFrame:
    """One point per distinct score, from the strictest threshold down."""
    ranked = running_sums(_scores(df, label, score), [], -F.col("score"),
                          {"tp": F.col("_p"), "fp": F.col("_n")}, target_rows,
                          light_slicing(df, 1, target_rows))
    rows = scored_rows(df, score)
    ones = rows.agg(F.count_if(F.col(label) == 1)).scalar()
    zeros = rows.agg(F.count_if(F.col(label) == 0)).scalar()
    return ranked.select(
        F.col("score").alias("threshold"), "tp", "fp",
        _ratio(F.col("tp").cast("double"), ones).alias("tpr"),
        _ratio(F.col("fp").cast("double"), zeros).alias("fpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            target_rows: float = TARGET_ROWS) -> DataFrame:
    """Area under the curve by trapezoids: positives before each score, plus half the ties."""
    ranked = running_sums(_scores(df, label, score), [], -F.col("score"),
                          {"tp": F.col("_p"), "fp": F.col("_n")}, target_rows,
                          light_slicing(df, 1, target_rows))
    area = F.sum(F.col("_n").cast("double") * (F.col("tp") - F.col("_p") / 2.0))
    ones, zeros = F.sum("_p"), F.sum("_n")
    usable = (ones > 0) & (zeros > 0)
    return ranked.agg(F.when(usable, area / (ones.cast("double") * zeros)).alias("roc_auc"))


def staged_auc(df: DataFrame, stage: str = "stage", label: str = "label", score: str = "score",
               target_rows: float = TARGET_ROWS) -> DataFrame:
    """Area under the curve of every stage, from one aggregation: per positive the negatives below
    it, plus half the ties. Null where a stage lacks a class."""
    counts = scored_rows(df, score).groupBy(stage, F.col(score).alias("_at")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    ranked = running_sums(counts, [stage], F.col("_at"), {"_upto": F.col("_n")}, target_rows)
    area = F.sum(F.col("_p").cast("double") * (F.col("_upto") - F.col("_n") / 2.0))
    ones, zeros = F.sum("_p"), F.sum("_n")
    return ranked.groupBy(stage).agg(
        F.when((ones > 0) & (zeros > 0), area / (ones.cast("double") * zeros)).alias("roc_auc"))


def default_metrics(metrics: DataFrame, wanted: float = DEFAULT_THRESHOLD,
                    order: list[float] = THRESHOLDS) -> DataFrame:
    """Metrics of the wanted threshold, else of the first one tested that has any."""
    place = F.coalesce(*[F.when(F.col("threshold") == t, i) for i, t in enumerate(order)],
                       F.lit(len(order)))
    rank = F.when(F.col("threshold") == wanted, -1).otherwise(place)
    usable = metrics.where(F.col("accuracy").isNotNull())
    row = F.struct(*metrics.columns)
    return usable.agg(F.min_by(row, rank).alias("m")).where("m IS NOT NULL").select("m.*")


def metrics_long(metrics: DataFrame, run_id: str) -> DataFrame:
    """Run-log form: one row per metric, named with its threshold."""
    pairs = F.array(*[F.struct(
        F.concat(F.lit("th_"), F.format_number("threshold", 2), F.lit(f"_{m}")).alias("key"),
        F.col(m).cast("double").alias("value")) for m in METRICS])
    return metrics.select(F.lit(run_id).alias("run_id"), F.explode(pairs).alias("p")).select(
        "run_id", "p.*")
