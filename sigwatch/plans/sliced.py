"""Twins of the ordered queries, cut so finely that heavy keys are sliced at every scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigwatch.constants import OPERATIONS
from sigwatch.operators import features, metrics, sip
from sigwatch.plans import evaluation, sequences, sip as sip_plans  # noqa: F401  their SQL is shared
from sigwatch.plans.registry import CHECKS, query
from sigwatch.plans.views import records, scored_events, sig, sip_messages

#: Rows of a slice as a share of all; the tables' largest keys have more at every scale.
SHARE = 1 / 2048


@query("running_count_imsi_sliced", CHECKS["running_count_imsi"])
def running_count_imsi(spark, sf_dir):
    rows = sig(spark, sf_dir).select("event_id", "c_imsi", "op", "ts")
    return features.message_count(rows, ["op", "c_imsi"], target_rows=SHARE).select(
        "event_id", "c_imsi", "f_msg_count_per_imsi")


@query("between_lu_rate_sliced", CHECKS["between_lu_rate"])
def between_lu_rate(spark, sf_dir):
    found = features.sequence_features(records(spark, sf_dir), target_rows=SHARE)
    return found.select("event_id", "gap_seconds", *[f"f_frequent_ok_{op}_between2lu" for op in OPERATIONS])


@query("roc_points_sliced", CHECKS["roc_points"])
def roc_points(spark, sf_dir):
    return metrics.roc_points(scored_events(spark, sf_dir), target_rows=1 / 64)


@query("roc_auc_sliced", CHECKS["roc_auc"])
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored_events(spark, sf_dir), target_rows=1 / 64).select(
        F.round("roc_auc", 9).alias("roc_auc"))


@query("threshold_window_exact_sliced", CHECKS["threshold_window_exact"])
def threshold_window_exact(spark, sf_dir):
    alerts = sip.threshold_windows(sip_messages(spark, sf_dir), sip.is_invite(F.col("msg")), "src", 3, 21_600,
                                   target_rows=SHARE)
    return alerts.select("src", *[F.col(c).cast("timestamp_ntz").alias(c)
                                  for c in ("window_start", "alert_at")], "n_messages")
