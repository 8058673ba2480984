"""SIP events and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigwatch.constants import SIP_CLASS_SEVERITY, SIP_RULES
from sigwatch.operators import actions, sip
from sigwatch.operators.lists import valid_candidates
from sigwatch.plans.registry import query
from sigwatch.plans.views import IDS, SIP, ids_lines, sip_messages
from sigwatch.sources.tables import parse_ids_events

_FLOWS = f"""{IDS}, parsed AS (SELECT json_extract_string(line, '$.timestamp') AS timestamp,
 json_extract_string(line, '$.src_ip') AS src_ip,
 COALESCE(json_extract_string(line, '$.dest_ip'), '') AS dest_ip,
 json_extract_string(line, '$.proto') AS proto,
 COALESCE(len(json_keys(line, '$.alert')) > 0, false) AS alerted,
 json_extract_string(line, '$.alert.signature') AS signature FROM ids WHERE json_valid(line)),
flows AS (SELECT timestamp, src_ip, dest_ip, proto, CASE WHEN alerted THEN 1 ELSE 0 END AS label,
 CASE WHEN alerted THEN COALESCE(signature, 'SIP Alert') ELSE '' END AS alert_msg FROM parsed)"""


def _flows(spark, sf_dir):
    """Parse the event lines, leave out malformed ones, flatten."""
    return sip.flatten_events(parse_ids_events(ids_lines(spark, sf_dir), "line"))


@query("sip_flatten", f"WITH {_FLOWS} SELECT * FROM flows")
def sip_flatten(spark, sf_dir):
    return _flows(spark, sf_dir)


@query("sip_alert_payload", f"""WITH {_FLOWS} SELECT CAST(to_json({{'timestamp': timestamp,
 'src_ip': src_ip, 'dest_ip': dest_ip, 'proto': proto, 'alert_msg': alert_msg}}) AS VARCHAR) AS value
FROM flows WHERE label = 1""")
def sip_alert_payload(spark, sf_dir):
    return actions.sip_alert_payload(_flows(spark, sf_dir))


@query("sip_block_sources", f"WITH {_FLOWS} SELECT DISTINCT src_ip AS ip FROM flows WHERE label = 1")
def sip_block_sources(spark, sf_dir):
    return valid_candidates(_flows(spark, sf_dir).where("label = 1"), "src_ip")


# Messages of the tables are minutes apart, so windows are hours long here.
def _rate(word: str, count: int, hours: int) -> str:
    return f"""WITH {SIP} SELECT time_bucket(INTERVAL {hours} HOURS, ts) AS window_start, src,
 count(*) AS n_messages FROM sip WHERE contains(msg, '{word}') GROUP BY ALL
 HAVING count(*) >= {count}"""


@query("sip_invite_flood", _rate("INVITE", 2, 24))
def sip_invite_flood(spark, sf_dir):
    rows = sip_messages(spark, sf_dir)
    return sip.tumbling_rate(rows, sip.is_invite(F.col("msg")), "src", 2, "24 hours")


@query("sip_register_enum", _rate("REGISTER", 3, 12))
def sip_register_enum(spark, sf_dir):
    rows = sip_messages(spark, sf_dir)
    return sip.tumbling_rate(rows, sip.is_register(F.col("msg")), "src", 3, "12 hours")


_UNKNOWN = (r"contains(msg, 'SIP/2.0') AND regexp_matches(msg, '(?im)^[A-Z]+\s+sip:') "
            r"AND NOT regexp_matches(msg, '(?im)^(?:INVITE|REGISTER|BYE|OPTIONS\s)')")
_AGENT = "contains(msg, 'User-Agent:') AND contains(lower(msg), 'sqlmap')"


@query("sip_unknown_method", f"WITH {SIP} SELECT event_id, src FROM sip WHERE {_UNKNOWN}")
def sip_unknown_method(spark, sf_dir):
    return sip_messages(spark, sf_dir).where(sip.is_unknown_method(F.col("msg"))).select(
        "event_id", "src")


@query("sip_bad_agent", f"WITH {SIP} SELECT event_id, src FROM sip WHERE {_AGENT}")
def sip_bad_agent(spark, sf_dir):
    return sip_messages(spark, sf_dir).where(sip.is_bad_agent(F.col("msg"))).select("event_id", "src")


_RULES = ", ".join(f"({sid}, '{cls}', '{text}', {SIP_CLASS_SEVERITY[cls]})"
                   for sid, cls, text in SIP_RULES)


@query("sip_alert_classified", f"""WITH {SIP}, alerts AS (
 SELECT event_id, src, CAST(1000003 AS BIGINT) AS sid FROM sip WHERE {_UNKNOWN}
 UNION ALL SELECT event_id, src, 1000004 FROM sip WHERE {_AGENT}),
rules(sid, classtype, message, severity) AS (VALUES {_RULES})
SELECT event_id, src, alerts.sid, classtype, message AS msg, severity
FROM alerts JOIN rules ON alerts.sid = rules.sid""")
def sip_alert_classified(spark, sf_dir):
    messages = sip_messages(spark, sf_dir)
    alerts = sip.content_alerts(messages, "msg").select("event_id", "src", "sid")
    return sip.classify(alerts).select("event_id", "src", "sid", "classtype", "msg", "severity")


@query("threshold_window_exact", f"""WITH RECURSIVE {SIP},
moments AS (SELECT src, epoch_us(ts) AS us FROM sip WHERE contains(msg, 'INVITE')),
opened AS (SELECT src, min(us) AS start FROM moments GROUP BY src
 UNION ALL
 SELECT o.src, (SELECT min(m.us) FROM moments m WHERE m.src = o.src AND m.us >= o.start + 21600000000)
 FROM opened o WHERE o.start IS NOT NULL),
placed AS (SELECT o.src, o.start, m.us, row_number() OVER (PARTITION BY o.src, o.start ORDER BY m.us)
 AS n, count(*) OVER (PARTITION BY o.src, o.start) AS n_messages
 FROM opened o JOIN moments m ON m.src = o.src AND m.us >= o.start AND m.us < o.start + 21600000000)
SELECT src, make_timestamp(start) AS window_start, make_timestamp(us) AS alert_at, n_messages
FROM placed WHERE n = 3""")
def threshold_window_exact(spark, sf_dir):
    rows = sip_messages(spark, sf_dir)
    alerts = sip.threshold_windows(rows, sip.is_invite(F.col("msg")), "src", 3, 21_600)
    return alerts.select("src", *[F.col(c).cast("timestamp_ntz").alias(c)
                                  for c in ("window_start", "alert_at")], "n_messages")
