"""Per-subscriber sequence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigwatch.constants import OPERATIONS
from sigwatch.operators import features
from sigwatch.operators.rules import detect
from sigwatch.plans.detection import _FLAGS, _SCORE, _THREAT
from sigwatch.plans.registry import query
from sigwatch.plans.views import RECORD, SIG, UPDATES, location_updates, records, sig

_COUNTED = f"""{SIG}, parts AS (SELECT event_id, ts, c_imsi, op, COALESCE(sum(CASE WHEN op IN
 ('ul', 'ulgprs') THEN 1 ELSE 0 END) OVER (PARTITION BY c_imsi ORDER BY ts, event_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM sig),
counted AS (SELECT event_id, ts, c_imsi, """ + ", ".join(
    f"count(*) FILTER (op = '{op}') OVER (PARTITION BY c_imsi, part ORDER BY ts, event_id "
    f"ROWS UNBOUNDED PRECEDING) AS f_count_ok_{op}_between2lu" for op in OPERATIONS) + """,
 least(CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT))
  OVER (PARTITION BY c_imsi ORDER BY ts, event_id), 900) AS gap FROM parts)"""


def _counted(spark, sf_dir):
    return features.between_lu_counts(records(spark, sf_dir))


@query("running_count_imsi", f"""WITH {SIG} SELECT event_id, c_imsi, row_number() OVER
 (PARTITION BY op, c_imsi ORDER BY ts, event_id) AS f_msg_count_per_imsi FROM sig""")
def running_count_imsi(spark, sf_dir):
    """Count per subscriber, starting again for each source (here: the operation)."""
    rows = sig(spark, sf_dir).select("event_id", "c_imsi", "op", "ts")
    return features.message_count(rows, ["op", "c_imsi"]).select(
        "event_id", "c_imsi", "f_msg_count_per_imsi")


@query("between_lu_counts", f"WITH {_COUNTED} SELECT event_id, "
       + ", ".join(f"f_count_ok_{op}_between2lu" for op in OPERATIONS) + " FROM counted")
def between_lu_counts(spark, sf_dir):
    return _counted(spark, sf_dir).select(
        "event_id", *[f"f_count_ok_{op}_between2lu" for op in OPERATIONS])


@query("between_lu_rate", f"WITH {_COUNTED} SELECT event_id, CAST(COALESCE(gap, 900) AS BIGINT) "
       "AS gap_seconds, " + ", ".join(
           f"f_count_ok_{op}_between2lu / (COALESCE(gap, 900) + CAST(1 AS DOUBLE)) "
           f"AS f_frequent_ok_{op}_between2lu" for op in OPERATIONS) + " FROM counted")
def between_lu_rate(spark, sf_dir):
    return features.sequence_features(records(spark, sf_dir)).select("event_id", "gap_seconds",
                        *[f"f_frequent_ok_{op}_between2lu" for op in OPERATIONS])


@query("sai_lu_gap", f"""WITH {_COUNTED} SELECT event_id, f_count_ok_sai_between2lu
 - (f_count_ok_ul_between2lu + f_count_ok_ulgprs_between2lu) AS f_count_gap_ok_sai_and_all_lu
FROM counted""")
def sai_lu_gap(spark, sf_dir):
    return features.sai_lu_gap(_counted(spark, sf_dir)).select(
        "event_id", "f_count_gap_ok_sai_and_all_lu")


@query("ratio_cl_psi", f"""WITH {_COUNTED} SELECT event_id, round(ln((f_count_ok_cl_between2lu
 + CAST(1e-5 AS DOUBLE)) / (f_count_ok_psi_between2lu + CAST(1e-5 AS DOUBLE))), 9) AS f_ratio_cl_psi
FROM counted""")
def ratio_cl_psi(spark, sf_dir):
    return features.ratio_cl_psi(_counted(spark, sf_dir)).select(
        "event_id", F.round("f_ratio_cl_psi", 9).alias("f_ratio_cl_psi"))


# Events of the tables are minutes apart, so the window is wider than five minutes here.
@query("high_activity", f"""WITH {SIG} SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY c_imsi
 ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END
 AS f_high_activity_5min FROM sig""")
def high_activity(spark, sf_dir):
    rows = sig(spark, sf_dir).select("event_id", "c_imsi", "ts")
    return features.high_activity(rows, window_seconds=21_600, at_least=3).select(
        "event_id", "f_high_activity_5min")


_HALF = "sin(radians({b} - {a}) / 2)"
_CHORD = (f"pow({_HALF.format(a='plat', b='lat')}, 2) + cos(radians(plat)) * cos(radians(lat)) "
          f"* pow({_HALF.format(a='plon', b='lon')}, 2)")


@query("impossible_travel", f"""WITH {UPDATES}, linked AS (SELECT *,
 lag(us) OVER w AS pus, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM updates
 WINDOW w AS (PARTITION BY c_imsi ORDER BY ts, event_id)),
measured AS (SELECT event_id, us - pus AS gap,
 CASE WHEN pus IS NOT NULL THEN 2 * CAST(6371 AS DOUBLE) * asin(least(sqrt({_CHORD}), 1)) END
 AS km FROM linked)
SELECT event_id, round(km, 3) AS distance_km, CASE WHEN CASE WHEN gap > 0
 THEN km > gap / CAST(3600000000 AS DOUBLE) * 1000 ELSE km > 0 END THEN 1 ELSE 0 END
 AS f_velocity_greater_than_1000 FROM measured""")
def impossible_travel(spark, sf_dir):
    return features.impossible_travel(location_updates(spark, sf_dir)).select(
        "event_id", F.round("distance_km", 3).alias("distance_km"), "f_velocity_greater_than_1000")


@query("countries_last_x", f"""WITH {UPDATES} SELECT a.event_id,
 count(DISTINCT b.country) AS f_count_unloop_country_last_x_hours_ul
FROM updates a JOIN updates b ON a.c_imsi = b.c_imsi AND b.us BETWEEN a.us - 259200000000 AND a.us
GROUP BY a.event_id""")
def countries_last_x(spark, sf_dir):
    return features.countries_last_hours(location_updates(spark, sf_dir), hours=72).select(
        "event_id", "f_count_unloop_country_last_x_hours_ul")


_FAN_OUT = f"""{SIG}, fan_out AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, c_cggt,
 count(*) AS n_psi, CASE WHEN count(DISTINCT c_network_node_number) > 1 THEN 1 ELSE 0 END
 AS f_one_cggt_multi_cdgt_psi FROM sig WHERE op = 'psi' GROUP BY ALL)"""


@query("one_to_many_psi", f"WITH {_FAN_OUT} SELECT * FROM fan_out")
def one_to_many_psi(spark, sf_dir):
    return features.psi_fan_out(records(spark, sf_dir), "c_cggt", "c_network_node_number", "6 hours")


@query("one_to_many_psi_rows", f"""WITH {_FAN_OUT} SELECT event_id,
 COALESCE(f_one_cggt_multi_cdgt_psi, 0) AS f_one_cggt_multi_cdgt_psi FROM sig s LEFT JOIN fan_out f
 ON f.c_cggt = s.c_cggt AND f.window_start = time_bucket(INTERVAL 6 HOURS, ts)""")
def one_to_many_psi_rows(spark, sf_dir):
    rows = features.with_psi_fan_out(records(spark, sf_dir), "c_cggt", "c_network_node_number",
                                     "6 hours")
    return rows.select("event_id", "f_one_cggt_multi_cdgt_psi")


# Rules over features computed from the records themselves, not over given ones.
_DERIVED = f"""{_COUNTED}, numbered AS (SELECT event_id, row_number() OVER (PARTITION BY c_imsi
 ORDER BY ts, event_id) AS f_msg_count_per_imsi FROM sig),
derived AS (SELECT s.event_id, s.c_imsi, s.src_ip, s.c_cggt, s.c_network_node_number, s.hex_payload,
 s.f_same_cggt_is_hlr_oc, n.f_msg_count_per_imsi, c.f_count_ok_sri_between2lu,
 c.f_count_ok_psi_between2lu, c.f_count_ok_ul_between2lu,
 c.f_count_ok_sri_between2lu / (COALESCE(c.gap, 900) + CAST(1 AS DOUBLE)) AS f_frequent_ok_sri_between2lu
 FROM sig s JOIN counted c USING (event_id) JOIN numbered n USING (event_id)),
flagged AS (SELECT *, {_FLAGS} FROM derived)"""


@query("threat_from_records", f"""WITH {_DERIVED} SELECT event_id, CAST({_SCORE} AS INT) AS threat_score,
 CASE WHEN {_SCORE} >= 3 THEN 1 ELSE 0 END AS label, {_THREAT} AS main_threat FROM flagged""")
def threat_from_records(spark, sf_dir):
    """From raw records to labels: all sequence features in one shuffle, then the rules."""
    given = ["hex_payload", "f_same_cggt_is_hlr_oc"]
    rows = sig(spark, sf_dir).select(*RECORD, *given)
    return detect(features.sequence_features(rows)).select(
        "event_id", "threat_score", "label", "main_threat")
