"""Each rule at its limits, the score, the label and the main threat."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from sigwatch.constants import BAD_ADDRESSES, BAD_RANGES, FEATURE_TABLE
from sigwatch.functions.netaddr import cidr_bounds, ip_to_long, is_private, within
from sigwatch.functions.payload import has_signature
from sigwatch.operators.actions import action, notice_payload, risk
from sigwatch.operators.lists import block_additions, block_status, load_addresses
from sigwatch.operators.rules import detect

QUIET = {"f_msg_count_per_imsi": 1, "c_network_node_number": "1000000001",
         "f_count_ok_sri_between2lu": 0, "f_frequent_ok_sri_between2lu": 0.0,
         "f_count_ok_psi_between2lu": 0, "f_count_ok_ul_between2lu": 0, "c_cggt": "CGGT_1000",
         "f_same_cggt_is_hlr_oc": 1, "src_ip": "10.1.1.1", "c_imsi": "242011111111100",
         "hex_payload": "00ff"}
SCHEMA = ("n int, f_msg_count_per_imsi long, c_network_node_number string, "
          "f_count_ok_sri_between2lu long, f_frequent_ok_sri_between2lu double, "
          "f_count_ok_psi_between2lu long, f_count_ok_ul_between2lu long, c_cggt string, "
          "f_same_cggt_is_hlr_oc int, src_ip string, c_imsi string, hex_payload string")

# Changed fields, rules expected to hold, score.
CASES = [
    ({}, set(), 0),
    ({"f_msg_count_per_imsi": 50}, set(), 0),
    ({"f_msg_count_per_imsi": 51}, {"flooding"}, 3),
    ({"c_network_node_number": "9999999999"}, {"unauth_node"}, 3),
    ({"c_network_node_number": None}, set(), 0),
    ({"f_count_ok_sri_between2lu": 15}, set(), 0),
    ({"f_count_ok_sri_between2lu": 16}, {"sri"}, 3),
    ({"f_count_ok_sri_between2lu": 5, "f_frequent_ok_sri_between2lu": 1.0}, set(), 0),
    ({"f_count_ok_sri_between2lu": 6, "f_frequent_ok_sri_between2lu": 1.0}, {"sri"}, 3),
    ({"f_count_ok_psi_between2lu": 10}, set(), 0),
    ({"f_count_ok_psi_between2lu": 11}, {"psi"}, 3),
    ({"f_count_ok_ul_between2lu": 5, "f_same_cggt_is_hlr_oc": 0}, set(), 0),
    ({"f_count_ok_ul_between2lu": 6, "c_cggt": "x_Roaming", "f_same_cggt_is_hlr_oc": 0},
     {"hlr_update", "roaming_bypass"}, 5),
    ({"src_ip": "8.8.8.8", "c_cggt": "CGGT_foreign"}, {"spoofing"}, 2),
    ({"src_ip": "172.16.0.1", "c_cggt": "CGGT_external"}, set(), 0),
    ({"src_ip": "172.17.0.1", "c_cggt": "CGGT_external"}, {"spoofing"}, 2),
    ({"src_ip": None, "c_cggt": "CGGT_external"}, {"spoofing"}, 2),
    ({"src_ip": "8.8.8.8", "c_cggt": "cggt_external"}, set(), 0),
    ({"c_cggt": "ROAMING", "f_same_cggt_is_hlr_oc": None}, {"roaming_bypass"}, 2),
    ({"c_imsi": None}, {"integrity"}, 2),
    ({"c_imsi": "24201111111110"}, {"integrity"}, 2),
    ({"c_imsi": "24201111111110a"}, {"integrity"}, 2),
    ({"c_imsi": "242011111111100\n"}, {"integrity"}, 2),
    ({"hex_payload": "00a10302010102011630ff"}, {"payload"}, 2),
    ({"hex_payload": "0a10302010102011630f"}, set(), 0),
    ({"hex_payload": "00a10a02010102011630ff"}, set(), 0),
    ({"src_ip": "45.148.10.84"}, {"blocklist"}, 1),
    ({"src_ip": "198.8.127.255"}, {"blocklist"}, 1),
    ({"src_ip": "198.8.128.0"}, set(), 0),
    ({"src_ip": "127.0.0.1"}, {"blocklist"}, 1),
    ({"src_ip": "198.8.96.999"}, set(), 0),
    ({"src_ip": "2001:db8::1"}, set(), 0),
    ({"src_ip": ""}, set(), 0),
]


@pytest.fixture(scope="module")
def detected(spark):
    rows = [(i, *{**QUIET, **change}.values()) for i, (change, _, _) in enumerate(CASES)]
    return {r["n"]: r for r in detect(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_rule_limits(detected, n):
    row, (_, rules, score) = detected[n], CASES[n]
    assert {k[5:] for k, v in row.asDict().items() if k.startswith("rule_") and v} == rules
    assert row["threat_score"] == score
    assert row["label"] == int(score >= 3)


def test_main_threat_order_and_default(spark):
    rows = [(0, *{**QUIET, "f_msg_count_per_imsi": 99, "c_imsi": ""}.values()),
            (1, *{**QUIET, "c_imsi": "", "hex_payload": "a10302010102011630"}.values()),
            (2, *QUIET.values())]
    names = [r["main_threat"] for r in detect(spark.createDataFrame(rows, SCHEMA)).orderBy("n").collect()]
    assert names == ["Flooding IMSI", "Integridad de datos sospechosa", "Anomalía SS7"]


def test_modes_and_missing_columns(spark):
    rows = [(0, *{**QUIET, "f_count_ok_psi_between2lu": 11, "hex_payload": "a10302010102011630"}.values())]
    frame = spark.createDataFrame(rows, SCHEMA)
    strict = detect(frame, check_private=True, payload_as_text=True).first()
    assert not strict["rule_psi"] and not strict["rule_payload"]
    bare = detect(spark.createDataFrame([(1,)], "n int")).first()
    assert bare["threat_score"] == 2 + 0 and bare["rule_integrity"]


def test_all_signatures_and_long_payload(spark):
    texts = ["a10502010102011630", "a1ff020100" + "02012d", "a20302010130aa02014630",
             "a10302010102010230", "a103020101020103a3", "a1030201ff02010730",
             "00" * 70_000 + "A10302010102011630", "00" * 70_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in frame.orderBy("i").select(has_signature(F.col("t"))).collect()]
    assert found == [True] * 7 + [False]


def test_addresses_against_the_standard_library(spark):
    texts = ["0.0.0.0", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.9.9", "172.15.255.255",
             "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.0.8", "192.0.0.9", "192.0.0.10",
             "192.0.0.170", "192.0.2.1", "192.168.255.1", "192.169.0.1", "198.17.0.1", "198.18.0.1",
             "198.19.255.255", "198.20.0.0", "198.51.100.7", "203.0.113.1", "203.0.114.1",
             "223.255.255.255", "240.0.0.1", "255.255.255.255", "1.2.3", "01.2.3.4", "1.2.3.256",
             "1.2.3.4.5", "a.b.c.d", "", " 1.2.3.4", "1.2.3.4\n", "::1"]
    frame = spark.createDataFrame([(t,) for t in texts], "ip string")
    for r in frame.select("ip", ip_to_long(F.col("ip")).alias("n"), is_private(F.col("ip")).alias("p"),
                          within(ip_to_long(F.col("ip")), BAD_RANGES).alias("bad")).collect():
        try:
            address = ipaddress.IPv4Address(r["ip"])
        except ValueError:
            assert r["n"] is None and not r["p"] and not r["bad"]
            continue
        assert r["n"] == int(address) and r["p"] == address.is_private
        assert r["bad"] == any(address in ipaddress.ip_network(c) for c in BAD_RANGES)


def test_cidr_text_bounds(spark):
    frame = spark.createDataFrame([("10.1.2.3/8",), ("1.2.3.4/32",), ("0.0.0.0/0",), ("x/8",), ("1.2.3.4/40",)], "c string")
    low, high = cidr_bounds(F.col("c"))
    got = [tuple(r) for r in frame.select(low, high).collect()]
    one = int(ipaddress.IPv4Address("1.2.3.4"))
    assert got == [(167772160, 184549375), (one, one), (0, 2 ** 32 - 1), (None, None), (None, None)]


def test_risk_bands(spark):
    frame = spark.createDataFrame([(0.5,), (0.5001,), (0.9,), (0.9001,), (0.0,), (1.0,)], "p double")
    got = [r[0] for r in frame.select(action(risk(F.col("p")))).collect()]
    assert got == ["monitorear", "notificar", "notificar", "bloquear", "monitorear", "bloquear"]


def test_notice_text(spark):
    frame = spark.sql("SELECT '1.2.3.4' AS ip, timestamp'2024-01-02 03:04:05.5' AS t")
    text = frame.select(notice_payload(F.col("ip"), F.col("t"))).first()[0]
    assert text == ('{"timestamp":"2024-01-02T03:04:05.500000","tipo_alerta":"ALERTA_MODERADA",'
                    '"ip_origen":"1.2.3.4","mensaje":"Se detectó una alerta moderada desde la IP '
                    '1.2.3.4. El operador debe tomar medidas."}')


def test_blocking_is_exact_and_validates(spark, tmp_path):
    (tmp_path / "list.txt").write_text("1.2.3.40\n\n  5.6.7.8 \n5.6.7.8\n")
    known = load_addresses(spark, str(tmp_path / "list.txt"))
    assert {r["ip"] for r in known.collect()} == {"1.2.3.40", "5.6.7.8"}
    rows = spark.createDataFrame([("1.2.3.4",), ("1.2.3.4",), ("5.6.7.8",), ("x; rm",), (None,)], "src_ip string")
    assert [r["ip"] for r in block_additions(rows, known).collect()] == ["1.2.3.4"]
    assert {tuple(r) for r in block_status(rows, known).collect()} == {
        ("1.2.3.4", "success"), ("5.6.7.8", "info")}


def test_fixed_lists():
    assert len(BAD_ADDRESSES) == 48 == len(set(BAD_ADDRESSES))
    assert len(FEATURE_TABLE) == 53 == len(set(FEATURE_TABLE))
    assert sum(c.startswith("f_") for c in FEATURE_TABLE) == 46


def test_keys_of_both_families(spark):
    import ipaddress
    import random

    from sigwatch.functions.netaddr import cidr_keys, ip_key
    draw = random.Random(3)
    texts = ["1.2.3.4", "255.255.255.255", "::", "::1", "1::", "2001:db8::7", "1:2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2", "", None, "1.2.3", "::1.2.3.4"]
    texts += [str(ipaddress.IPv6Address(draw.getrandbits(128) & draw.getrandbits(128))) for _ in range(50)]
    keys = {r.ip: r.k for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", ip_key(F.col("ip")).alias("k")).collect()}
    for text, key in keys.items():
        try:
            address = ipaddress.ip_address(text or "")
        except ValueError:
            address = None
        if text == "::1.2.3.4":  # a mixed spelling, refused as by the validity check
            address = None
        assert key == (address and f"{address.version}{int(address):0{8 if address.version == 4 else 32}x}"), text
    nets = [f"{draw.choice([t for t in texts if keys.get(t)])}/{draw.randint(0, 32)}" for _ in range(60)]
    nets += [f"{t}/{n}" for t in texts[-10:] for n in (33, 57, 127, 128)]
    for r in spark.createDataFrame([(n,) for n in nets], "c string").select("c", *[k.alias(n) for n, k in zip("ab", cidr_keys(F.col("c")))]).collect():
        net = ipaddress.ip_network(r.c, strict=False)
        width = 8 if net.version == 4 else 32
        assert (r.a, r.b) == tuple(f"{net.version}{int(e):0{width}x}" for e in (net[0], net[-1])), r.c
    bad = spark.createDataFrame([(c,) for c in ("1.2.3.4/33", "::/129", "1.2.3.4", "x/8", None, "1.2.3.4/-1")], "c string")
    assert all(r == (None, None) for r in map(tuple, bad.select(*cidr_keys(F.col("c"))).collect()))


def test_sweep_equals_brute_force(spark):
    import random

    from sigwatch.operators.lists import covered_points
    draw = random.Random(5)
    for width in (3, 400):
        ranges = [(a, a + draw.randint(0, width)) for a in (draw.randint(0, 5000) for _ in range(60))] + [(7, 7), (7, 9)]
        points = [draw.randint(0, 5500) for _ in range(700)] + [None]
        found = covered_points(spark.createDataFrame([(p,) for p in points], "at long").repartition(5),
                               spark.createDataFrame(ranges, "first long, last long"))
        assert sorted(r.at for r in found.collect()) == sorted({p for p in points if p is not None and any(a <= p <= b for a, b in ranges)})
    none = spark.createDataFrame([], "first long, last long")
    assert covered_points(spark.createDataFrame([(1,)], "at long"), none).count() == 0
