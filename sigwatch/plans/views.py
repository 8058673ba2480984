"""Input views over the given tables, in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigwatch.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Signalling records over the event table; {S} is the text type of the engine.
_SIG = {
    "event_id": "event_id", "ts": "ts", "user_id": "user_id", "value": "value",
    "c_imsi": "CASE WHEN event_id % 97 = 0 THEN '24201' "
              "ELSE concat('242', lpad(CAST(user_id AS {S}), 12, '0')) END",
    "op": "CASE event_type WHEN 'signup' THEN 'ul' WHEN 'click' THEN 'cl' WHEN 'view' THEN 'psi' "
          "WHEN 'purchase' THEN 'sri' ELSE 'sai' END",
    "src_ip": "CASE WHEN user_id % 10 = 0 THEN concat('45.148.10.', CAST(event_id % 256 AS {S})) "
              "WHEN user_id % 10 = 1 THEN concat('198.8.', CAST(90 + event_id % 50 AS {S}), '.7') "
              "WHEN user_id % 10 = 2 THEN concat('203.0.', CAST(event_id % 256 AS {S}), '.9') "
              "ELSE concat('10.97.', CAST(user_id % 256 AS {S}), '.', "
              "CAST(event_id % 256 AS {S})) END",
    "c_cggt": "concat(CASE WHEN event_id % 5 = 0 THEN 'CGGT_ROAMING_' ELSE 'CGGT_' END, "
              "CAST(1000 + user_id % 7 AS {S}))",
    "c_network_node_number": "CASE WHEN event_id % 41 = 0 THEN '9999999999' "
                             "ELSE CAST(1000000000 + user_id AS {S}) END",
    "f_same_cggt_is_hlr_oc": "CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INT)",
    "f_count_ok_sri_between2lu": "CAST(event_id % 19 AS INT)",
    "f_frequent_ok_sri_between2lu": "CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INT)",
    "f_count_ok_psi_between2lu": "CAST(event_id % 13 AS INT)",
    "f_count_ok_ul_between2lu": "CAST(event_id % 8 AS INT)",
    "hex_payload": "CASE WHEN event_id % 53 = 0 THEN '00a10302010102011630' ELSE '00ff00ff' END",
}

# Raw record columns, without the feature stand-ins.
RECORD = ["event_id", "ts", "c_imsi", "op", "src_ip", "c_cggt", "c_network_node_number"]


def _select(columns: dict[str, str], text: str) -> list[str]:
    return [f"{e.format(S=text)} AS {n}" for n, e in columns.items()]


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(_SIG, "STRING"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig(spark, sf_dir).select(*RECORD)


# SIP messages over the event table.
_SIP = {
    "event_id": "event_id", "ts": "ts",
    "src": "concat('u', CAST(user_id AS {S}))",
    "msg": "concat(CASE event_type WHEN 'signup' THEN 'REGISTER' WHEN 'view' THEN 'INVITE' "
           "WHEN 'click' THEN 'OPTIONS' WHEN 'purchase' THEN 'BYE' ELSE 'FUZZ' END, ' sip:', "
           "CAST(user_id AS {S}), ' SIP/2.0', chr(10), "
           "CASE WHEN event_id % 3 = 0 THEN 'User-Agent: ' ELSE 'user-agent: ' END, "
           "CASE WHEN event_id % 7 = 0 THEN 'SQLmap/1.' ELSE 'phone/2.' END, props)",
}


def sip_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(_SIP, "STRING"))


# IDS events as JSON text: alert with signature, without, empty, or none at all.
_IDS = {
    "event_id": "event_id",
    "line": "concat('{{\"timestamp\":\"', CAST(event_id AS {S}), '\",\"src_ip\":\"10.0.0.', "
            "CAST(user_id % 256 AS {S}), '\"', "
            "CASE WHEN event_id % 11 = 0 THEN '' ELSE ',\"dest_ip\":\"200.55.128.3\"' END, "
            "',\"proto\":\"', CASE WHEN event_id % 4 = 0 THEN 'TCP' ELSE 'UDP' END, '\"', "
            "CASE event_type WHEN 'error' THEN ',\"alert\":{{\"signature\":\"SIP fuzz\",\"gid\":1}}' "
            "WHEN 'click' THEN ',\"alert\":{{\"gid\":1}}' WHEN 'view' THEN ',\"alert\":{{}}' "
            "ELSE '' END, CASE WHEN event_id % 17 = 0 THEN '' ELSE '}}' END)",
}


def ids_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(_IDS, "STRING"))


# Scored events: score from the value, label from the event type.
_SCORED = {
    "event_id": "event_id", "score": "least(value / 100, 1.0)",
    "label": "CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT)",
    "source_file": "concat(event_type, '.csv')",
}


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(_SCORED, "STRING"))


# Records with one of four kinds of timestamp text or none.
_STAMPED = {
    "event_id": "event_id", "c_imsi": _SIG["c_imsi"], "op": _SIG["op"],
    "c_timestamp": "CASE event_id % 6 WHEN 0 THEN concat('2024-01-', lpad(CAST(1 + user_id % 28 "
                   "AS {S}), 2, '0'), ' 10:20:30') "
                   "WHEN 1 THEN concat('2022-02-19T22:22:', lpad(CAST(user_id % 60 AS {S}), 2, '0'), "
                   "'.000+01:00') "
                   "WHEN 2 THEN CAST(1645305776 + user_id AS {S}) "
                   "WHEN 3 THEN 'not a time' WHEN 4 THEN '2024-13-45 10:00:00' ELSE NULL END",
}


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(_STAMPED, "STRING"))


# Location updates with a country and a place computed from its key.
_NATION_OF = "CAST((user_id * 7 + event_id) % 25 AS INT)"


def location_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = (sig(spark, sf_dir).where("op = 'ul'")
               .selectExpr("event_id", "ts", "c_imsi", f"{_NATION_OF} AS n_nationkey"))
    nations = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_name").alias("country"),
        ((F.col("n_nationkey") * 7) % 120 - 60).cast("double").alias("lat"),
        ((F.col("n_nationkey") * 29) % 360 - 180).cast("double").alias("lon"))
    return updates.join(nations, "n_nationkey")


def node_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(1000000000 + s_suppkey AS STRING) AS node",
        "CAST(s_suppkey % 2 AS INT) AS is_hlr",
        "CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS is_gmlc")


def _cte(name: str, columns: dict[str, str]) -> str:
    body = ",\n  ".join(_select(columns, "VARCHAR"))
    return f"{name} AS (SELECT\n  {body}\n FROM events)"


SIG = _cte("sig", _SIG)
SIP = _cte("sip", _SIP)
IDS = _cte("ids", _IDS)
SCORED = _cte("scored", _SCORED)
STAMPED = _cte("stamped", _STAMPED)
UPDATES = f"""{SIG}, updates AS (
 SELECT event_id, ts, epoch_us(ts) AS us, c_imsi, n_name AS country,
  CAST((n_nationkey * 7) % 120 - 60 AS DOUBLE) AS lat,
  CAST((n_nationkey * 29) % 360 - 180 AS DOUBLE) AS lon
 FROM sig JOIN nation ON n_nationkey = {_NATION_OF} WHERE op = 'ul')"""
DIRECTORY = """directory AS (SELECT CAST(1000000000 + s_suppkey AS VARCHAR) AS node,
  CAST(s_suppkey % 2 AS INT) AS is_hlr,
  CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS is_gmlc FROM supplier)"""
