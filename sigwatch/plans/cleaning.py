"""Scans, validation, cleaning, de-duplication and profiling."""

from __future__ import annotations

from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from sigwatch.functions.checks import valid_imsi, valid_timestamp
from sigwatch.operators import quality
from sigwatch.plans.registry import query
from sigwatch.plans.views import SIG, STAMPED, sig, stamped, table
from sigwatch.schemas import feature_table
from sigwatch.session import shared_dir
from sigwatch.sources.tables import read_csv, write_csv

_CSV = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("c_imsi", T.StringType()),
                     T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


_IMSI_TEXT = "CASE WHEN event_id % 2 = 0 THEN concat('00', CAST(user_id AS {S})) ELSE '242' END AS c_imsi"


@query("scan_csv_roundtrip", f"""SELECT event_id, {_IMSI_TEXT.format(S='VARCHAR')}, value, props
FROM events""")
def scan_csv_roundtrip(spark, sf_dir):
    """Write a CSV folder and read it back with a declared schema; identifiers stay text."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", _IMSI_TEXT.format(S="STRING"), "value", "props")
    path = shared_dir(spark, "roundtrip")
    write_csv(rows, path)
    return read_csv(spark, path, _CSV)


@query("json_extract_default", """SELECT event_id,
 COALESCE(json_extract_string(props, '$.k'), '') AS k,
 COALESCE(json_extract_string(props, '$.proto'), '') AS proto FROM events""")
def json_extract_default(spark, sf_dir):
    def field(name):
        return F.coalesce(F.get_json_object("props", f"$.{name}"), F.lit("")).alias(name)
    return table(spark, sf_dir, "events").select("event_id", field("k"), field("proto"))


@query("project_prefix", f"""WITH {SIG} SELECT f_same_cggt_is_hlr_oc, f_count_ok_sri_between2lu,
 f_frequent_ok_sri_between2lu, f_count_ok_psi_between2lu, f_count_ok_ul_between2lu FROM sig""")
def project_prefix(spark, sf_dir):
    rows = sig(spark, sf_dir)
    return rows.select(*quality.with_prefix(rows, "f_"))


_DUCK_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}
_PRESENT = {"src_ip", "hex_payload", "c_cggt", "c_imsi", "f_same_cggt_is_hlr_oc",
            "f_count_ok_sri_between2lu", "f_frequent_ok_sri_between2lu",
            "f_count_ok_psi_between2lu", "f_count_ok_ul_between2lu", "c_network_node_number"}
_ALIGNED = ", ".join(
    f"CAST({f.name if f.name in _PRESENT else 'NULL'} AS {_DUCK_TYPE[f.dataType.simpleString()]}) "
    f"AS {f.name}" for f in feature_table().fields)


@query("align_schema", f"WITH {SIG} SELECT {_ALIGNED} FROM sig")
def align_schema(spark, sf_dir):
    return quality.align(sig(spark, sf_dir), feature_table())


_IMSI_OK = "regexp_full_match(c_imsi, '[0-9]{15}')"
_TIME_OK = ("(c_timestamp IS NOT NULL AND (try_strptime(c_timestamp, ['%Y-%m-%d %H:%M:%S', "
            "'%Y-%m-%dT%H:%M:%S.%g%z']) IS NOT NULL OR TRY_CAST(c_timestamp AS BIGINT) IS NOT NULL))")


@query("valid_imsi", f"WITH {STAMPED} SELECT event_id, CAST({_IMSI_OK} AS INT) AS is_valid FROM stamped")
def imsi_validity(spark, sf_dir):
    return stamped(spark, sf_dir).select("event_id",
                                         valid_imsi(F.col("c_imsi")).cast("int").alias("is_valid"))


@query("valid_timestamp", f"WITH {STAMPED} SELECT event_id, CAST({_TIME_OK} AS INT) AS is_valid FROM stamped")
def timestamp_validity(spark, sf_dir):
    return stamped(spark, sf_dir).select(
        "event_id", valid_timestamp(F.col("c_timestamp")).cast("int").alias("is_valid"))


@query("validate_rows", f"WITH {STAMPED} SELECT * FROM stamped WHERE {_IMSI_OK} AND {_TIME_OK}")
def validate_rows(spark, sf_dir):
    return quality.validate(stamped(spark, sf_dir))


@query("validation_report", f"""WITH {STAMPED},
marked AS (SELECT c_imsi, c_timestamp, op, {_IMSI_OK} AND {_TIME_OK} AS ok FROM stamped),
kept AS (SELECT DISTINCT c_imsi, c_timestamp, op FROM marked WHERE ok)
SELECT count(*) AS rows_in, count(*) FILTER (ok) AS rows_valid,
 count(*) FILTER (NOT ok) AS rows_invalid,
 count(*) FILTER (ok) - (SELECT count(*) FROM kept) AS duplicates,
 (SELECT count(*) FROM kept) AS rows_out FROM marked""")
def validation_report(spark, sf_dir):
    return quality.validation_report(stamped(spark, sf_dir).drop("event_id"))


_TEXT_NUMBER = ("CASE event_id % 5 WHEN 0 THEN CAST(event_id AS {S}) WHEN 1 THEN 'n/a' WHEN 2 THEN '' "
                "WHEN 3 THEN concat(' ', CAST(event_id AS {S}), '.5 ') ELSE NULL END AS reading")


@query("coerce_numeric", f"""SELECT event_id, TRY_CAST(trim(reading) AS DOUBLE) AS reading
FROM (SELECT event_id, {_TEXT_NUMBER.format(S='VARCHAR')} FROM events)""")
def coerce_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", _TEXT_NUMBER.format(S="STRING"))
    return quality.coerce_numeric(rows, ["reading"])


def _labelled_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


_DOCS = "(SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query("clean_target", f"SELECT doc_id, toxic FROM {_DOCS} WHERE toxic IS NOT NULL")
def clean_target(spark, sf_dir):
    return quality.clean_target(_labelled_documents(spark, sf_dir).select("doc_id", "toxic"), "toxic")


@query("impute_mean", f"""SELECT doc_id,
 round(COALESCE(quality, (SELECT avg(quality) FROM {_DOCS})), 9) AS quality,
 round(COALESCE(toxic, (SELECT avg(toxic) FROM {_DOCS})), 9) AS toxic FROM {_DOCS}""")
def impute_mean(spark, sf_dir):
    rows = quality.coerce_numeric(
        _labelled_documents(spark, sf_dir).select("doc_id", "quality", "toxic"), ["quality", "toxic"])
    filled = quality.fit_imputer(rows, ["quality", "toxic"]).transform(rows)
    return filled.select("doc_id", F.round("quality", 9).alias("quality"),
                         F.round("toxic", 9).alias("toxic"))


@query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS total_rows FROM {_DOCS}"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def null_profile(spark, sf_dir):
    return quality.null_profile(_labelled_documents(spark, sf_dir))


@query("dedup_all", "SELECT DISTINCT text, lang, source FROM documents")
def dedup_all(spark, sf_dir):
    return quality.distinct_rows(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("dedup_subset_first", """SELECT doc_id, lang, source, n_chars, text FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedup_subset_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return quality.first_of_each(rows, ["text"], ["doc_id"])


@query("dedup_keep_first_line", """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def dedup_keep_first_line(spark, sf_dir):
    """Of lines alike in two columns the first in the files stays; the files hold later events first."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = shared_dir(spark, "lines")
    write_csv(rows.repartitionByRange(4, F.desc("event_id")).sortWithinPartitions(F.desc("event_id")), path)
    lines = read_csv(spark, path, rows.schema, file_order=True)
    return quality.clean(lines, ["event_id"], duplicate_subset=["user_id", "event_type"])


@query("class_counts", "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def class_counts(spark, sf_dir):
    return quality.class_counts(table(spark, sf_dir, "labels"), "toxic")


@query("class_weight", """SELECT n0, n1, CASE WHEN n1 > 0 THEN CAST(n0 AS DOUBLE) / n1 ELSE 1.0 END
 AS pos_weight FROM (SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1
 FROM labels)""")
def class_weight(spark, sf_dir):
    return quality.class_weight(table(spark, sf_dir, "labels"), "toxic")


@query("dataset_summary", "SELECT count(*) AS num_samples, avg(toxic) AS fraud_ratio FROM labels")
def dataset_summary(spark, sf_dir):
    return quality.dataset_summary(table(spark, sf_dir, "labels"), "toxic")


@query("union_rows", """SELECT event_id, event_type, value, CAST(NULL AS INT) AS label FROM events
UNION ALL SELECT event_id, event_type, NULL, 1 FROM events WHERE event_type = 'error'""")
def union_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    extra = (events.where("event_type = 'error'")
             .select("event_id", "event_type", F.lit(1).alias("label")))
    return events.select("event_id", "event_type", "value").unionByName(
        extra, allowMissingColumns=True)


@query("oldest_first", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 1")
def oldest_first(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(1).select(
        "event_id", "event_type")


@query("head_n", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 10")
def head_n(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(
        "event_id").limit(10)


@query("first_n_per_key", """SELECT event_id, event_type, packet_no FROM (SELECT event_id, event_type,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS packet_no FROM events)
WHERE packet_no <= 100""")
def first_n_per_key(spark, sf_dir):
    """The limit on the row number is applied on the map side, before the shuffle."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return (rows.withColumn("packet_no", F.row_number().over(order)).where("packet_no <= 100")
            .select("event_id", "event_type", F.col("packet_no").cast("bigint").alias("packet_no")))
