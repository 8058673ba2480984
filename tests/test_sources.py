import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwatch.operators import actions, quality
from sigwatch.operators.sip import flatten_events, is_bad_agent, is_unknown_method
from sigwatch.schemas import SIP_FLOWS, feature_table, training_table
from sigwatch.sources import captures
from sigwatch.sources.tables import (
    detect_delimiter, read_csv, read_ids_events, write_csv, write_features, write_messages, write_summary,
)

NAMES = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])


def test_encoding_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n007,José\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,name\n008,Muñoz\n".encode("latin-1"))
    got = read_csv(spark, str(tmp_path), NAMES, detect_encoding=True, source_column="file").collect()
    assert {tuple(r) for r in got} == {("007", "José", "a.csv"), ("008", "Muñoz", "b.csv")}
    only = read_csv(spark, str(tmp_path / "b.csv"), NAMES, detect_encoding=True).collect()
    assert [tuple(r) for r in only] == [("008", "Muñoz")]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter(spark, tmp_path, sep):
    path = tmp_path / "x.csv"
    path.write_text("".join(f"{i}{sep}n{i}{sep}{i * 2}\n" for i in range(30)))
    assert detect_delimiter(spark, str(path)) == sep


def test_delimiter_default(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert detect_delimiter(spark, str(tmp_path / "empty.csv")) == ","


def test_empty_and_missing_sources(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "empty.csv"), NAMES).count() == 0
    gone = read_csv(spark, str(tmp_path / "gone.csv"), NAMES, source_column="file")
    assert gone.count() == 0 and gone.columns == ["id", "name", "file"]
    (tmp_path / "list.json").write_text("[]\n")
    assert flatten_events(read_ids_events(spark, str(tmp_path / "list.json"))).count() == 0


def test_identifiers_keep_leading_zeros(spark, tmp_path):
    frame = spark.createDataFrame([("00242", "x")], NAMES)
    write_csv(frame, str(tmp_path / "out"), sep=";")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "out"), NAMES, sep=";").collect()] == [("00242", "x")]


def test_ids_events(spark, tmp_path):
    lines = ['{"timestamp":"t1","src_ip":"1.1.1.1","dest_ip":"2.2.2.2","proto":"UDP",'
             '"alert":{"signature":"bad","metadata":{"a":[1]}}}',
             '{"timestamp":"t2","src_ip":"1.1.1.2","alert":{}}',
             '{"timestamp":"t3","src_ip":"1.1.1.3","alert":{"gid":1}}',
             '{"timestamp":"t4","src_ip":', '{"timestamp":"t5","src_ip":"1.1.1.5","alert":null}']
    path = tmp_path / "eve.json"
    path.write_text("\n".join(lines) + "\n")
    events = read_ids_events(spark, str(path))
    got = {tuple(r) for r in flatten_events(events).collect()}
    assert got == {("t1", "1.1.1.1", "2.2.2.2", "UDP", 1, "bad"), ("t2", "1.1.1.2", "", "", 0, ""),
                   ("t3", "1.1.1.3", "", "", 1, "SIP Alert"), ("t5", "1.1.1.5", "", "", 0, "")}
    assert read_ids_events(spark, str(path), keep_bad=True).count() == 1
    payloads = [json.loads(r[0]) for r in actions.sip_alert_payload(flatten_events(events)).collect()]
    assert {p["alert_msg"] for p in payloads} == {"bad", "SIP Alert"}


def test_message_rules(spark):
    texts = ["INVITE sip:a SIP/2.0", "ACK sip:a SIP/2.0", "fuzz sip:a SIP/2.0", "FUZZ sip:a", "OPTIONS sip:a SIP/2.0",
             "x\nCANCEL  sip:b SIP/2.0", "User-Agent: SqlMap", "user-agent: sqlmap"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string").orderBy("i")
    got = frame.select(is_unknown_method(F.col("m")), is_bad_agent(F.col("m"))).collect()
    assert [r[0] for r in got] == [False, True, True, False, False, True, False, False]
    assert [r[1] for r in got] == [False] * 6 + [True, False]


def test_schemas():
    assert len(feature_table().fields) == 54
    assert len([f for f in training_table().fields if f.name.startswith("f_")]) == 43
    assert SIP_FLOWS.fieldNames()[-2:] == ["label", "alert_msg"]


def test_sinks(spark, tmp_path):
    rows = quality.align(spark.createDataFrame([("1.1.1.1", 1)], "src_ip string, label int"), feature_table())
    write_features(rows, str(tmp_path / "f"), "2024-01-01")
    write_features(rows, str(tmp_path / "f"), "2024-01-02")
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 2 and back.where("batch_date = '2024-01-02'").count() == 1
    write_messages(spark.createDataFrame([('{"a":1}',)], "value string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"a":1}'
    write_summary(quality.dataset_summary(rows), str(tmp_path / "s"))
    assert set(spark.read.json(str(tmp_path / "s")).columns) == {"num_samples", "fraud_ratio", "generated_at"}


# --- captures: a few packets written by hand ---

def ipv4(src):
    return bytes([0x45, 0, 0, 20, 0, 0, 0, 0, 64, 132, 0, 0]) + bytes(src) + bytes([9, 9, 9, 9])


def ipv6(last):
    return bytes([0x60]) + bytes(7) + bytes(15) + bytes([last]) + bytes(16)


def ethernet(kind, body, vlan=False):
    tag = b"\x81\x00\x00\x05" if vlan else b""
    return bytes(12) + tag + kind + body


V4, V6, ARP = b"\x08\x00", b"\x86\xdd", b"\x08\x06"


def classic(packets, order="<", link=1):
    magic = 0xA1B2C3D4
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(order + "IIII", 1, 2, len(p), len(p)) + p for p in packets)


def blocks(packets, link=1):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", link, 0, 0))
    for p in packets:
        out += block(6, struct.pack("<IIIII", 0, 0, 0, len(p), len(p)) + p)
    return out


def test_captures(spark, tmp_path):
    packets = [ethernet(V4, ipv4([1, 2, 3, 4])), ethernet(ARP, bytes(28)), ethernet(V6, ipv6(7)),
               ethernet(V4, ipv4([5, 6, 7, 8]), vlan=True), b"\x01"]
    (tmp_path / "a.pcap").write_bytes(classic(packets))
    (tmp_path / "b.pcap").write_bytes(classic(packets, ">"))
    (tmp_path / "c.pcap").write_bytes(blocks(packets))
    (tmp_path / "d.pcap").write_bytes(classic([ipv4([4, 4, 4, 4])], link=101) + b"\xff" * 20)
    (tmp_path / "e.pcap").write_bytes(b"")
    (tmp_path / "f.pcap").write_bytes(b"no capture at all, only text")
    (tmp_path / "g.txt").write_bytes(classic(packets))
    for chunk in (2, 1000):
        got = captures.read_packets(spark, str(tmp_path), chunk_packets=chunk).collect()
        for name in "abc":
            mine = sorted((r["packet_no"], r["src_ip"], r["hex_payload"]) for r in got
                          if r["path"].endswith(f"{name}.pcap"))
            expected = ["1.2.3.4", None, "::7", "5.6.7.8", None]
            assert mine == [(i, ip, p.hex()) for i, (ip, p) in enumerate(zip(expected, packets))]
        assert [r["src_ip"] for r in got if r["path"].endswith("d.pcap")] == ["4.4.4.4"]
        assert {r["path"][-6:-5] for r in got} == set("abcd")


def test_capture_limit(spark, tmp_path):
    many = [ethernet(V4, ipv4([1, 1, i // 256, i % 256])) for i in range(1200)]
    (tmp_path / "x.pcap").write_bytes(classic(many))
    (tmp_path / "y.pcap").write_bytes(blocks(many))
    for limit, n in ((1000, 1000), (None, 1200), (3, 3)):
        rows = captures.read_packets(spark, str(tmp_path), limit=limit, chunk_packets=100)
        counts = rows.groupBy("path").agg(F.count("*").alias("n"), F.max("packet_no").alias("last"),
                                          F.countDistinct("src_ip").alias("d")).collect()
        assert [(r["n"], r["last"], r["d"]) for r in counts] == [(n, n - 1, n)] * 2


def test_captures_keep_every_packet(spark, tmp_path):
    many = [ethernet(V4, ipv4([1, 1, i // 256, i % 256])) for i in range(1200)]
    (tmp_path / "x.pcap").write_bytes(classic(many))
    assert captures.read_packets(spark, str(tmp_path)).count() == 1200


def test_columns_go_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,other,id\nAnn,1,007\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path), NAMES).collect()] == [("007", "Ann")]
    typed = T.StructType([T.StructField("other", T.IntegerType()), T.StructField("absent", T.StringType()),
                          T.StructField("name", T.IntegerType())])
    assert [tuple(r) for r in read_csv(spark, str(tmp_path), typed).collect()] == [(1, None, None)]
    with pytest.raises(quality.MissingColumns, match="absent"):
        read_csv(spark, str(tmp_path), typed, required=["name", "absent"])
    # Another header is an error, not a mix-up.
    (tmp_path / "b.csv").write_text("id,other,name\n008,2,Bob\n")
    with pytest.raises(Exception, match="header|schema"):
        read_csv(spark, str(tmp_path), NAMES).collect()
