"""Detection rules, threat score, label and main threat.

Every rule is one native expression, so the whole block is a single projection. Missing
columns and nulls take the neutral default of the rule.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from sigwatch.constants import (
    ANOMALY_SCORE, BAD_ADDRESSES, BAD_RANGES, FOREIGN_WORDS, HOME_NETWORKS, HOME_PREFIXES,
    OTHER_THREAT, RULES, UNAUTHORISED_NODES,
)
from sigwatch.functions.netaddr import ip_to_long, public_only, within
from sigwatch.functions.payload import has_signature
from sigwatch.operators.lists import listed_addresses


def _field(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def rule_columns(df: DataFrame, *, check_private: bool = False,
                 payload_as_text: bool = False) -> dict[str, Column]:
    """Boolean expression of each rule by name.

    ``check_private`` limits the location-tracking rule to addresses outside the home
    networks; by default that term is always true, as in the published rules.
    ``payload_as_text`` searches byte patterns in the hex text, which never matches.
    """
    messages = _field(df, "f_msg_count_per_imsi", 0)
    node = _field(df, "c_network_node_number", "")
    sri = _field(df, "f_count_ok_sri_between2lu", 0)
    sri_often = _field(df, "f_frequent_ok_sri_between2lu", 0) == 1
    psi = _field(df, "f_count_ok_psi_between2lu", 0) > 10
    updates = _field(df, "f_count_ok_ul_between2lu", 0)
    title = _field(df, "c_cggt", "")
    not_home_hlr = _field(df, "f_same_cggt_is_hlr_oc", 0) == 0
    ip = _field(df, "src_ip", "")
    imsi = _field(df, "c_imsi", "")
    payload = _field(df, "hex_payload", "")

    roaming = F.lower(title).contains("roaming")
    outside = reduce(and_, [~ip.startswith(p) for p in HOME_PREFIXES])
    foreign = reduce(or_, [F.lower(title).contains(w) for w in FOREIGN_WORDS])
    number = ip_to_long(ip)
    return {
        "flooding": messages > 50,
        "unauth_node": node.isin(UNAUTHORISED_NODES),
        "sri": (sri > 15) | ((sri > 5) & sri_often),
        "psi": psi & ~within(number, HOME_NETWORKS) if check_private else psi,
        "hlr_update": (updates > 5) & roaming & not_home_hlr,
        "spoofing": outside & title.startswith("CGGT_") & foreign,
        "roaming_bypass": roaming & not_home_hlr,
        "integrity": ~imsi.rlike(r"^[0-9]{15}\z"),
        "payload": F.lit(False) if payload_as_text else has_signature(payload),
        "blocklist": ip.isin(BAD_ADDRESSES) | within(number, public_only(BAD_RANGES)),
    }


def threat_score(flags: dict[str, Column]) -> Column:
    return reduce(add, [F.when(flags[name], weight).otherwise(0) for name, weight, _ in RULES])


def main_threat(flags: dict[str, Column]) -> Column:
    """Name of the first rule that holds, in the fixed order."""
    return F.coalesce(*[F.when(flags[name], threat) for name, _, threat in RULES],
                      F.lit(OTHER_THREAT))


def detect(df: DataFrame, addresses: DataFrame | None = None, ranges: DataFrame | None = None,
           **options) -> DataFrame:
    """Add ``rule_*`` flags, ``threat_score``, ``label`` and ``main_threat``.

    With ``addresses`` (column ip) or ``ranges`` (columns lo, hi) the block list is what these
    tables hold, else the compiled one.
    """
    rules = rule_columns(df, **options)
    if addresses is not None or ranges is not None:
        listed = listed_addresses(df, addresses, ranges).select(F.col("src_ip").alias("_listed"))
        df = df.join(listed, F.col("src_ip") == F.col("_listed"), "left")
        rules["blocklist"] = F.col("_listed").isNotNull()
    flagged = df.withColumns({f"rule_{n}": c for n, c in rules.items()}).drop("_listed")
    named = {name: F.col(f"rule_{name}") for name, _, _ in RULES}
    scored = flagged.withColumn("threat_score", threat_score(named))
    return scored.withColumns({
        "label": (F.col("threat_score") >= ANOMALY_SCORE).cast("int"),
        "main_threat": main_threat(named),
    })
