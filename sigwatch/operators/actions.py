"""Risk bands and outgoing messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sigwatch.constants import (
    ACTION_BLOCK, ACTION_MONITOR, ACTION_NOTIFY, BLOCK_OVER, NOTICE_KIND, NOTICE_TEXT, NOTIFY_OVER,
)

ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def risk(probability: Column) -> Column:
    return F.round(probability * 100, 2)


def action(risk_percent: Column) -> Column:
    """Both limits belong to the band below them."""
    return (F.when(risk_percent > BLOCK_OVER, ACTION_BLOCK)
            .when(risk_percent > NOTIFY_OVER, ACTION_NOTIFY).otherwise(ACTION_MONITOR))


def score_results(scored: DataFrame, probability: str, ip: str = "src_ip",
                  source: str = "source_file") -> DataFrame:
    results = scored.select(F.col(ip).alias("ip_origen"), risk(F.col(probability)).alias("riesgo"),
                            F.col(source).alias("fuente_log"))
    return results.withColumn("accion", action(F.col("riesgo"))).select(
        "ip_origen", "riesgo", "accion", "fuente_log")


def action_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("fuente_log", "accion").agg(F.count("*").alias("n"))


def iso(moment: Column) -> Column:
    return F.date_format(moment, ISO_TIME)


def alert_payload(ip: Column, moment: Column, threat: Column) -> Column:
    return F.to_json(F.struct(ip.alias("ip"), iso(moment).alias("timestamp"),
                              threat.alias("amenaza")))


def notice_payload(ip: Column, moment: Column) -> Column:
    text = F.format_string(NOTICE_TEXT, ip)
    return F.to_json(F.struct(iso(moment).alias("timestamp"), F.lit(NOTICE_KIND).alias("tipo_alerta"),
                              ip.alias("ip_origen"), text.alias("mensaje")))


def sip_alert_payload(flows: DataFrame) -> DataFrame:
    fields = ["timestamp", "src_ip", "dest_ip", "proto", "alert_msg"]
    return flows.where("label = 1").select(F.to_json(F.struct(*fields)).alias("value"))
