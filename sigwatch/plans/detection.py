"""Detection rules, list lookups, messages and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigwatch.constants import BAD_ADDRESSES, BAD_RANGES, HOME_NETWORKS, PRIVATE_BLOCKS, RULES
from sigwatch.functions.netaddr import bounds, ip_to_long, is_private
from sigwatch.functions.payload import to_hex
from sigwatch.operators import actions, lists
from sigwatch.operators.features import message_count
from sigwatch.operators.rules import detect, rule_columns
from sigwatch.plans.registry import query
from sigwatch.plans.views import DIRECTORY, SCORED, SIG, node_directory, sig, table
from sigwatch.session import shared_dir

_IP = ("(CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 "
       "+ CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 "
       "+ CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 "
       "+ CAST(split_part(src_ip, '.', 4) AS BIGINT))")


def _between(cidrs: list[str]) -> str:
    return "(" + " OR ".join(
        "{0} BETWEEN {1} AND {2}".format(_IP, *bounds(c)) for c in cidrs) + ")"


_LISTED = "src_ip IN (" + ", ".join(f"'{a}'" for a in BAD_ADDRESSES) + ")"
_DOT = "(?:0[0-9b-f]|[1-9a-f][0-9a-f])"
_PAYLOAD = "|".join([f"a1{_DOT}02010102011630", f"a1{_DOT}0201{_DOT}02012d",
                     f"a2{_DOT}02010130{_DOT}02014630", f"a1{_DOT}02010102010230",
                     f"a1{_DOT}020101020103a3", f"a1{_DOT}0201{_DOT}02010730"])
_ROAMING = "contains(lower(c_cggt), 'roaming')"
_RULE_SQL = {
    "flooding": "f_msg_count_per_imsi > 50",
    "unauth_node": "c_network_node_number = '9999999999'",
    "sri": "f_count_ok_sri_between2lu > 15 OR (f_count_ok_sri_between2lu > 5 "
           "AND f_frequent_ok_sri_between2lu = 1)",
    "psi": "f_count_ok_psi_between2lu > 10",
    "hlr_update": f"f_count_ok_ul_between2lu > 5 AND {_ROAMING} AND f_same_cggt_is_hlr_oc = 0",
    "spoofing": "NOT (starts_with(src_ip, '10.') OR starts_with(src_ip, '192.168') "
                "OR starts_with(src_ip, '172.16')) AND starts_with(c_cggt, 'CGGT_') "
                f"AND ({_ROAMING} OR contains(lower(c_cggt), 'foreign') "
                "OR contains(lower(c_cggt), 'external'))",
    "roaming_bypass": f"{_ROAMING} AND f_same_cggt_is_hlr_oc = 0",
    "integrity": "length(c_imsi) <> 15 OR NOT regexp_full_match(c_imsi, '[0-9]+')",
    "payload": f"regexp_matches(hex_payload, '^(?:[0-9a-f]{{2}})*?(?:{_PAYLOAD})')",
    "blocklist": f"{_LISTED} OR {_between(BAD_RANGES)}",
}
COUNTED = f"""{SIG}, counted AS (SELECT *, row_number() OVER
 (PARTITION BY c_imsi ORDER BY ts, event_id) AS f_msg_count_per_imsi FROM sig)"""
_FLAGS = ", ".join(f"CAST(({p}) AS INT) AS r_{n}" for n, p in _RULE_SQL.items())
_SCORE = " + ".join(f"{w} * r_{n}" for n, w, _ in RULES)
_THREAT = "CASE " + " ".join(f"WHEN r_{n} = 1 THEN '{t}'" for n, _, t in RULES) + (
    " ELSE 'Anomalía SS7' END")
LABELLED = f"""{COUNTED}, flagged AS (SELECT *, {_FLAGS} FROM counted),
labelled AS (SELECT *, CAST({_SCORE} AS INT) AS threat_score,
 CASE WHEN {_SCORE} >= 3 THEN 1 ELSE 0 END AS label, {_THREAT} AS main_threat FROM flagged)"""


def labelled(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return detect(message_count(sig(spark, sf_dir)), **options)


def _add_rule(name: str, sql: str, key: str | None = None, **options) -> None:
    key = key or f"rule_{name}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sig(spark, sf_dir)
        if name == "flooding":
            rows = message_count(rows)
        return rows.select("event_id", rule_columns(rows, **options)[name].cast("int").alias(key))

    query(key, f"WITH {COUNTED} SELECT event_id, CAST(({sql}) AS INT) AS {key} FROM counted")(run)


for _name, _sql in _RULE_SQL.items():
    _add_rule(_name, _sql)
@query("rule_blocklist_table", f"WITH {COUNTED} SELECT event_id, CAST(({_RULE_SQL['blocklist']}) AS INT) "
       "AS rule_blocklist FROM counted")
def rule_blocklist_table(spark, sf_dir):
    """The block list as tables, joined instead of compiled into the rules."""
    found = detect(sig(spark, sf_dir), lists.bad_addresses(spark), lists.bad_ranges(spark))
    return found.select("event_id", F.col("rule_blocklist").cast("int").alias("rule_blocklist"))


_add_rule("psi", f"{_RULE_SQL['psi']} AND NOT {_between(HOME_NETWORKS)}", "rule_psi_external",
          check_private=True)


@query("threat_score", f"WITH {LABELLED} SELECT event_id, threat_score FROM labelled")
def threat_score(spark, sf_dir):
    return labelled(spark, sf_dir).select("event_id", "threat_score")


@query("threat_label", f"WITH {LABELLED} SELECT event_id, c_imsi, src_ip, threat_score, label, "
                       "main_threat FROM labelled")
def threat_label(spark, sf_dir):
    """Flagship: count messages, apply all rules, label, and name the main threat."""
    return labelled(spark, sf_dir).select("event_id", "c_imsi", "src_ip", "threat_score", "label",
                                          "main_threat")


@query("main_threat", f"WITH {LABELLED} SELECT main_threat, count(*) AS n FROM labelled "
                      "WHERE label = 1 GROUP BY main_threat")
def main_threat(spark, sf_dir):
    return (labelled(spark, sf_dir).where("label = 1").groupBy("main_threat")
            .agg(F.count("*").alias("n")))


@query("filter_label", f"WITH {LABELLED} SELECT event_id, src_ip FROM labelled WHERE label = 1")
def filter_label(spark, sf_dir):
    return labelled(spark, sf_dir).where("label = 1").select("event_id", "src_ip")


@query("alerts_payload", f"""WITH {LABELLED}
SELECT CAST(to_json({{'ip': src_ip, 'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'),
 'amenaza': main_threat}}) AS VARCHAR) AS value FROM labelled WHERE label = 1""")
def alerts_payload(spark, sf_dir):
    rows = labelled(spark, sf_dir).where("label = 1")
    return rows.select(actions.alert_payload(F.col("src_ip"), F.col("ts"), F.col("main_threat"))
                       .alias("value"))


@query("ip_to_long", f"WITH {SIG} SELECT event_id, {_IP} AS ip_number FROM sig")
def ip_numbers(spark, sf_dir):
    return sig(spark, sf_dir).select("event_id", ip_to_long(F.col("src_ip")).alias("ip_number"))


@query("ip_is_private", f"WITH {SIG} SELECT event_id, CAST({_between(PRIVATE_BLOCKS)} AS INT) "
                        "AS is_private FROM sig")
def ip_private(spark, sf_dir):
    return sig(spark, sf_dir).select("event_id",
                                     is_private(F.col("src_ip")).cast("int").alias("is_private"))


@query("hex_payload", "SELECT event_id, lower(hex(props)) AS hex_payload FROM events")
def hex_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", to_hex(F.col("props").cast("binary")).alias("hex_payload"))


@query("semi_blocklist", f"WITH {SIG} SELECT event_id, src_ip FROM sig WHERE {_LISTED}")
def semi_blocklist(spark, sf_dir):
    rows = sig(spark, sf_dir).select("event_id", "src_ip")
    return (lists.in_addresses(rows, lists.bad_addresses(spark), "src_ip", "event_id")
            .select("event_id", "src_ip"))


@query("range_cidr", f"WITH {SIG} SELECT event_id, src_ip FROM sig WHERE {_between(BAD_RANGES)}")
def range_cidr(spark, sf_dir):
    rows = sig(spark, sf_dir).select("event_id", "src_ip")
    return lists.in_ranges(rows, lists.bad_ranges(spark), "src_ip", "event_id")


@query("range_table", f"""WITH {SIG}, ranges AS (SELECT DISTINCT
 10 * 16777216 + 97 * 65536 + (s_suppkey % 256) * 256 AS lo FROM supplier)
SELECT event_id, src_ip FROM sig WHERE EXISTS
 (SELECT 1 FROM ranges WHERE {_IP} BETWEEN lo AND lo + 255)""")
def range_table(spark, sf_dir):
    """Ranges kept as network texts in a table of any size."""
    networks = table(spark, sf_dir, "supplier").selectExpr(
        "concat('10.97.', CAST(s_suppkey % 256 AS STRING), '.0/24') AS cidr")
    rows = sig(spark, sf_dir).select("event_id", "src_ip")
    return lists.in_ranges(rows, lists.ranges_from_cidrs(networks), "src_ip", "event_id")


@query("range_both_families", f"""WITH {SIG}, nets AS (SELECT DISTINCT s_suppkey % 256 AS g FROM supplier),
 mixed AS (SELECT sig.event_id, sig.src_ip, events.user_id % 512 AS g FROM sig JOIN events ON events.event_id = sig.event_id)
SELECT event_id FROM mixed WHERE CASE event_id % 3 WHEN 0 THEN src_ip LIKE '10.%'
 WHEN 1 THEN g IN (SELECT g FROM nets)
 ELSE g BETWEEN 128 AND 255 OR 0 IN (SELECT g FROM nets) END""")
def range_both_families(spark, sf_dir):
    """Networks of both families, wide ones too, in one table; addresses in several spellings."""
    networks = table(spark, sf_dir, "supplier").selectExpr(
        "concat('2001:db8:', hex(s_suppkey % 256), '::/48') AS cidr").unionByName(
        spark.sql("SELECT * FROM VALUES ('10.0.0.0/8'), ('2001:db8:0:80::/57'), ('2001:db8::/129'), ('10.0.0.0') AS t(cidr)"))
    rows = sig(spark, sf_dir).select("event_id", "src_ip").join(
        table(spark, sf_dir, "events").selectExpr("event_id", "hex(user_id % 512) AS g", "hex(event_id % 65536) AS e"), "event_id")
    rows = rows.selectExpr("event_id", """CASE event_id % 3 WHEN 0 THEN src_ip
      WHEN 1 THEN concat('2001:db8:', lower(g), '::', e) ELSE concat('2001:0DB8:0:', g, ':0:0:0:', lower(e)) END AS ip""")
    return lists.in_ranges(rows, lists.ranges_from_cidrs(networks), "ip", "event_id").select("event_id")


@query("blocklist_load", f"WITH {SIG} SELECT DISTINCT src_ip AS ip FROM sig")
def blocklist_load(spark, sf_dir):
    """Address list from text files with blanks, spaces and repeats."""
    lines = sig(spark, sf_dir).selectExpr("explode(array(concat(' ', src_ip, ' '), '')) AS value")
    path = shared_dir(spark, "addresses")
    lines.write.text(path)
    return lists.load_addresses(spark, path)


_VALUES = ", ".join(f"('{a}')" for a in BAD_ADDRESSES)


@query("block_candidates", f"""WITH {LABELLED}, known(ip) AS (VALUES {_VALUES})
SELECT ip, CASE WHEN ip IN (SELECT ip FROM known) THEN 'info' ELSE 'success' END AS status
FROM (SELECT DISTINCT src_ip AS ip FROM labelled WHERE label = 1)""")
def block_candidates(spark, sf_dir):
    rows = labelled(spark, sf_dir).where("label = 1").select("src_ip")
    return lists.block_status(rows, lists.bad_addresses(spark))


@query("block_additions", f"""WITH {LABELLED}, known(ip) AS (VALUES {_VALUES})
SELECT DISTINCT src_ip AS ip FROM labelled WHERE label = 1 AND src_ip NOT IN (SELECT ip FROM known)""")
def block_additions(spark, sf_dir):
    rows = labelled(spark, sf_dir).where("label = 1").select("src_ip")
    return lists.block_additions(rows, lists.bad_addresses(spark))


@query("except_ips", f"""WITH {LABELLED}, known(ip) AS (VALUES {_VALUES})
SELECT src_ip AS ip FROM labelled WHERE label = 1 EXCEPT SELECT ip FROM known""")
def except_ips(spark, sf_dir):
    found = labelled(spark, sf_dir).where("label = 1").select(F.col("src_ip").alias("ip"))
    return found.distinct().exceptAll(lists.bad_addresses(spark))


@query("intersect_ips", f"""WITH {LABELLED}, known(ip) AS (VALUES {_VALUES})
SELECT src_ip AS ip FROM labelled WHERE label = 1 INTERSECT SELECT ip FROM known""")
def intersect_ips(spark, sf_dir):
    found = labelled(spark, sf_dir).where("label = 1").select(F.col("src_ip").alias("ip"))
    return found.intersect(lists.bad_addresses(spark))


_NODES = f"""WITH {SIG}, {DIRECTORY} SELECT event_id,
 COALESCE(is_hlr, 0) AS f_same_cggt_is_hlr_ossn, COALESCE(is_gmlc, 0) AS f_same_cggt_is_gmlc_ossn,
 CASE WHEN node IS NULL THEN 1 ELSE 0 END AS f_c_ossn_others
FROM sig LEFT JOIN directory ON c_network_node_number = node"""


def _node_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sig(spark, sf_dir).select("event_id", "c_network_node_number")
    return lists.with_node_flags(rows, node_directory(spark, sf_dir), "c_network_node_number",
                                 "event_id")


@query("node_type_flags", f"SELECT event_id, f_same_cggt_is_hlr_ossn, f_same_cggt_is_gmlc_ossn "
                          f"FROM ({_NODES})")
def node_type_flags(spark, sf_dir):
    return _node_flags(spark, sf_dir).select("event_id", "f_same_cggt_is_hlr_ossn",
                                             "f_same_cggt_is_gmlc_ossn")


@query("ossn_others", f"SELECT event_id, f_c_ossn_others FROM ({_NODES})")
def ossn_others(spark, sf_dir):
    return _node_flags(spark, sf_dir).select("event_id", "f_c_ossn_others")


_RISK = ("round(score * 100, 2) AS riesgo, CASE WHEN round(score * 100, 2) > 90 THEN 'bloquear' "
         "WHEN round(score * 100, 2) > 50 THEN 'notificar' ELSE 'monitorear' END AS accion")
_RESULTS = f"""{SIG}, {SCORED}, results AS (SELECT src_ip AS ip_origen, {_RISK},
 source_file AS fuente_log, ts FROM sig JOIN scored USING (event_id))"""


def _scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = sig(spark, sf_dir).select("event_id", "ts", "src_ip", "op",
                                          F.least(F.col("value") / 100, F.lit(1.0)).alias("score"))
    kinds = {"ul": "signup", "cl": "click", "psi": "view", "sri": "purchase", "sai": "error"}
    kind = F.coalesce(*[F.when(F.col("op") == k, v) for k, v in kinds.items()])
    return addresses.withColumn("source_file", F.concat(kind, F.lit(".csv")))


@query("risk_band", f"WITH {_RESULTS} SELECT ip_origen, riesgo, accion, fuente_log FROM results")
def risk_band(spark, sf_dir):
    return actions.score_results(_scored_records(spark, sf_dir), "score")


@query("action_summary", f"WITH {_RESULTS} SELECT fuente_log, accion, count(*) AS n FROM results "
                         "GROUP BY fuente_log, accion")
def action_summary(spark, sf_dir):
    return actions.action_summary(actions.score_results(_scored_records(spark, sf_dir), "score"))


@query("notices_payload", f"""WITH {_RESULTS}
SELECT CAST(to_json({{'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'),
 'tipo_alerta': 'ALERTA_MODERADA', 'ip_origen': ip_origen,
 'mensaje': concat('Se detectó una alerta moderada desde la IP ', ip_origen,
 '. El operador debe tomar medidas.')}}) AS VARCHAR) AS value
FROM results WHERE accion = 'notificar'""")
def notices_payload(spark, sf_dir):
    rows = _scored_records(spark, sf_dir)
    notify = rows.where(actions.action(actions.risk(F.col("score"))) == "notificar")
    return notify.select(actions.notice_payload(F.col("src_ip"), F.col("ts")).alias("value"))
