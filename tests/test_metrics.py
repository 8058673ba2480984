"""Metric operators against published counts and values."""

import pytest

from sigwatch.operators import metrics
from sigwatch.operators.metrics import class_report, default_metrics, metrics_long, threshold_metrics

# Holdout counts per threshold (tp, fp, tn, fn) and published metrics.
GOLDEN = {
    0.3: (253, 120, 1636, 62, 0.9121197489135683, 0.67828418230563, 0.8031746031746032,
          0.7354651162790697, 0.8413862929397664),
    0.4: (243, 41, 1715, 72, 0.9454369869628199, 0.8556338028169014, 0.7714285714285715,
          0.8113522537562604, 0.8897291892546473),
    0.5: (239, 25, 1731, 76, 0.951231289232255, 0.9053030303030303, 0.7587301587301587,
          0.8255613126079447, 0.8986072069635289),
    0.6: (238, 20, 1736, 77, 0.9531627233220666, 0.9224806201550387, 0.7555555555555555,
          0.8307155322862129, 0.9017685254594415),
}


@pytest.fixture(scope="module")
def golden(spark):
    """Rows whose scores give the published counts at every threshold."""
    marks = [0.25, 0.35, 0.45, 0.55, 0.65]
    at_least = {1: [315] + [g[0] for g in GOLDEN.values()], 0: [1756] + [g[1] for g in GOLDEN.values()]}
    rows = []
    for label, counts in at_least.items():
        for mark, n, after in zip(marks, counts, [*counts[1:], 0]):
            rows += [(label, mark)] * (n - after)
    return threshold_metrics(spark.createDataFrame(rows, "label int, score double"))


def test_threshold_metrics(golden):
    got = {r["threshold"]: r for r in golden.collect()}
    for t, (tp, fp, tn, fn, acc, p1, r1, f1, macro) in GOLDEN.items():
        row = got[t]
        assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (tp, fp, tn, fn)
        assert [row[c] for c in ("accuracy", "precision_1", "recall_1", "f1_1", "f1_macro")] == \
            pytest.approx([acc, p1, r1, f1, macro], abs=1e-12)


def test_report_rounds_to_published_lines(golden):
    lines = {r["line"]: r for r in class_report(golden.where("threshold = 0.5")).collect()}
    rounded = {k: tuple(None if v is None else round(v, 2)
                        for v in (r["precision"], r["recall"], r["f1_score"])) for k, r in lines.items()}
    assert rounded == {"Class 0": (0.96, 0.99, 0.97), "Class 1": (0.91, 0.76, 0.83),
                       "accuracy": (None, None, 0.95), "macro avg": (0.93, 0.87, 0.90),
                       "weighted avg": (0.95, 0.95, 0.95)}
    assert lines["weighted avg"]["support"] == 2071


def test_default_and_fallback(golden):
    assert default_metrics(golden).first()["threshold"] == 0.5
    assert default_metrics(golden.where("threshold <> 0.5")).first()["threshold"] == 0.3
    assert default_metrics(golden.where("threshold > 9")).count() == 0


def test_long_form(golden):
    got = {r["key"]: r["value"] for r in metrics_long(golden, "r").collect()}
    assert len(got) == 64 and got["th_0.50_tp"] == 239 and got["th_0.30_support_1"] == 315


def test_undefined_ratios_are_zero(spark):
    row = threshold_metrics(spark.createDataFrame([(1, 0.1)], "label int, score double"), thresholds=[0.5]).first()
    assert row["precision_1"] == 0 and row["recall_0"] == 0 and row["f1_0"] == 0 and row["fn"] == 1
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.1)], "label int, score double")).first()[0] is None
