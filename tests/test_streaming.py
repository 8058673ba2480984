import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwatch.operators.features import message_count
from sigwatch.operators.quality import align
from sigwatch.operators.rules import detect
from sigwatch.operators.sip import threshold_windows, tumbling_rate
from sigwatch.operators.training import make_classifier, train
from sigwatch.schemas import feature_table
from sigwatch.sources.topics import read_topic, write_topic
from sigwatch.streaming import counters, jobs
from sigwatch.streaming.keyed import KeyedTable

MESSAGES = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                         T.StructField("c_imsi", T.StringType())])


def put(folder, name, rows, age):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def put_features(spark, folder, name, rows, age):
    """One CSV file of feature rows given as dicts."""
    schema = feature_table()
    lines = [",".join(schema.fieldNames())]
    lines += [",".join("" if r.get(c) is None else str(r[c]) for c in schema.fieldNames()) for r in rows]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n" if rows else "")
    os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))


def base(ip, **change):
    return {"src_ip": ip, "c_imsi": "242011111111100", "c_cggt": "CGGT_1", "f_same_cggt_is_hlr_oc": 1,
            "f_msg_count_per_imsi": 1, "c_network_node_number": "1", **change}


def test_detection_stream_equals_batch_and_resumes(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    first = [base("1.1.1.1", f_msg_count_per_imsi=60), base("1.1.1.2")]
    second = [base("1.1.1.3", c_network_node_number="9999999999")]
    put_features(spark, inbox, "b.csv", first, 10)
    put_features(spark, inbox, "a.csv", second, 20)
    put_features(spark, inbox, "c.csv", [], 30)
    jobs.start_detection(spark, str(inbox), root).awaitTermination()
    labelled = spark.read.parquet(f"{root}/labelled")
    # Oldest file first, one file per batch.
    order = {r["source_file"]: r["batch_id"] for r in labelled.select("source_file", "batch_id").distinct().collect()}
    assert order == {"b.csv": 0, "a.csv": 1}
    schema = feature_table()
    batch = detect(align(spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames())
                                                for r in first + second], schema), schema))
    columns = ["src_ip", "threat_score", "label", "main_threat"]
    assert {tuple(r) for r in labelled.select(columns).collect()} == {tuple(r) for r in batch.select(columns).collect()}
    alerts = [json.loads(r["value"]) for r in spark.read.parquet(f"{root}/alerts").collect()]
    assert {(a["ip"], a["amenaza"]) for a in alerts} == {("1.1.1.1", "Flooding IMSI"), ("1.1.1.3", "Nodo no autorizado")}
    # A restart reads new files only.
    put_features(spark, inbox, "d.csv", [base("1.1.1.9")], 40)
    jobs.start_detection(spark, str(inbox), root).awaitTermination()
    assert spark.read.parquet(f"{root}/labelled").count() == 4


def test_scoring_routes_by_action(spark, tmp_path):
    train_rows = [(float(i % 10), float(i % 3), int(i % 10 > 6)) for i in range(300)]
    names = ["f_count_ok_cl_between2lu", "f_count_ok_psi_between2lu"]
    model = train(spark.createDataFrame(train_rows, [*names, "label"]), names,
                  make_classifier("rf", {"n_estimators": 5, "max_depth": 3, "random_state": 1}))
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    rows = [base("9.9.9.1", f_count_ok_cl_between2lu=9, f_count_ok_psi_between2lu=0, label=1),
            base("9.9.9.1", f_count_ok_cl_between2lu=9, f_count_ok_psi_between2lu=0, label=1),
            base("9.9.9.2", f_count_ok_cl_between2lu=1, f_count_ok_psi_between2lu=0, label=1),
            base("9.9.9.3", f_count_ok_cl_between2lu=9, f_count_ok_psi_between2lu=0, label=0)]
    put_features(spark, inbox, "a.csv", rows, 1)
    jobs.start_scoring(spark, str(inbox), root, model, every=None).awaitTermination()
    results = spark.read.parquet(f"{root}/results").collect()
    assert sorted((r["ip_origen"], r["accion"], r["fuente_log"]) for r in results) == [
        ("9.9.9.1", "bloquear", "a.csv")] * 2 + [("9.9.9.2", "monitorear", "a.csv")]
    assert [r["ip"] for r in jobs.blocklist(spark, root).collect()] == ["9.9.9.1"]
    put_features(spark, inbox, "b.csv", rows, 2)
    jobs.start_scoring(spark, str(inbox), root, model, every=None).awaitTermination()
    assert jobs._blocked_by_all(spark, root).count() == 1
    assert spark.read.parquet(f"{root}/results").count() == 6


def test_notices_for_the_middle_band(spark, tmp_path):
    class Half:
        """Stands in for a model: every row scores 0.7."""

    rows = spark.createDataFrame([("1.1.1.1", 0.7, "f"), ("1.1.1.2", 0.95, "f")], "src_ip string, p double, source_file string")
    original = jobs.score
    jobs.score = lambda df, model: df.withColumn("score", F.col("p"))
    try:
        jobs.scoring_handler(str(tmp_path), Half())(rows.withColumn("label", F.lit(1)), 0)
        jobs.scoring_handler(str(tmp_path), Half())(rows.withColumn("label", F.lit(1)), 0)
    finally:
        jobs.score = original
    notices = [json.loads(r["value"]) for r in spark.read.parquet(f"{tmp_path}/notices").collect()]
    assert [n["ip_origen"] for n in notices] == ["1.1.1.1"]
    # The same batch again neither repeats nor loses a blocked address.
    assert [r["ip"] for r in jobs.blocklist(spark, str(tmp_path)).collect()] == ["1.1.1.2"]


def test_sip_stream_blocks_alerting_sources(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    put(inbox, "a.json", [{"timestamp": "t", "src_ip": "5.5.5.5", "alert": {"signature": "s"}},
                          {"timestamp": "t", "src_ip": "5.5.5.6"}], 1)
    with open(inbox / "a.json", "a") as f:
        f.write("{broken\n\n")
    put(inbox, "b.json", [{"timestamp": "t", "src_ip": "5.5.5.5", "alert": {"gid": 1}}], 2)
    archive = tmp_path / "done"
    first = jobs.start_sip(spark, str(inbox), root, every=None, archive=str(archive))
    first.awaitTermination()
    flows = spark.read.parquet(f"{root}/flows")
    assert flows.count() == 3 and flows.where("label = 1").count() == 2
    assert [r["ip"] for r in jobs.blocklist(spark, root).collect()] == ["5.5.5.5"]
    assert jobs._blocked_by_all(spark, root).count() == 1


def test_two_streams_side_by_side_on_a_clock(spark, tmp_path):
    put_features(spark, tmp_path / "f", "a.csv", [base("1.1.1.1")], 1)
    put(tmp_path / "e", "a.json", [{"timestamp": "t", "src_ip": "5.5.5.5", "alert": {"gid": 1}}], 1)
    running = [jobs.start_detection(spark, str(tmp_path / "f"), str(tmp_path / "o1"), every="1 second"),
               jobs.start_sip(spark, str(tmp_path / "e"), str(tmp_path / "o2"), every="1 second")]
    for q in running:
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/o1/labelled").count() == 1
    assert spark.read.parquet(f"{tmp_path}/o2/flows").count() == 1


def test_topic_files(spark, tmp_path):
    (tmp_path / "alerts").mkdir()
    (tmp_path / "alerts" / "x.txt").write_text('{"a":1}\n')
    stream = read_topic(spark, "alerts", folder=str(tmp_path))
    write_topic(stream, "copy", str(tmp_path / "cp"), folder=str(tmp_path)).trigger(
        availableNow=True).start().awaitTermination()
    assert spark.read.text(str(tmp_path / "copy")).first()[0] == '{"a":1}'


@pytest.fixture(scope="module")
def message_rows():
    ids, at, out = iter(range(1000)), 1_700_000_000, []
    for i in range(120):
        at += [1, 1, 2, 9][i % 4]
        out.append({"event_id": next(ids), "ts": at, "c_imsi": "a" if i % 3 else "b"})
    return out


@pytest.fixture
def messages(spark, tmp_path, message_rows):
    rows = [{**r, "ts": f"@{r['ts']}"} for r in message_rows]
    from datetime import datetime, timezone
    for r, m in zip(rows, message_rows):
        r["ts"] = datetime.fromtimestamp(m["ts"], timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    inbox = tmp_path / "m"
    for n in range(4):
        put(inbox, f"{n}.json", rows[n * 30:(n + 1) * 30], n)
    # Event time must pass the last windows for the append mode to close them.
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).json(str(inbox))
    return stream, spark.read.schema(MESSAGES).json(str(inbox)), tmp_path


def run(stream, name, tmp_path, mode="append"):
    (stream.writeStream.format("memory").queryName(name).outputMode(mode)
     .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True)
     .start().awaitTermination())
    return stream.sparkSession.table(name)


def test_windowed_counts(spark, messages):
    stream, batch, tmp_path = messages
    got = run(counters.windowed_counts(stream, window="10 seconds"), "windowed", tmp_path, "update")
    latest = got.groupBy("start", "c_imsi").agg(F.max("n").alias("n"))
    expected = batch.groupBy(F.window("ts", "10 seconds").start.alias("start"), "c_imsi").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in latest.collect()} == {tuple(r) for r in expected.collect()}


def test_rate_alerts(spark, messages):
    stream, batch, tmp_path = messages
    got = run(counters.rate_alerts(stream, F.lit(True), "c_imsi", 2, "5 seconds"), "rates", tmp_path)
    expected = tumbling_rate(batch, F.lit(True), "c_imsi", 2, "5 seconds")
    last = batch.agg(F.max("ts")).first()[0]
    closed = {tuple(r) for r in expected.collect() if (last - r["window_start"]).total_seconds() > 15}
    found = {tuple(r) for r in got.collect()}
    assert closed and closed <= found <= {tuple(r) for r in expected.collect()}


def batches(spark, handle, rows, cuts):
    """Hand rows to a handler as micro-batches, each twice as after a failure."""
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        for _ in range(2):
            handle(spark.createDataFrame(rows[a:b], MESSAGES), n)


@pytest.mark.parametrize("target", [20, 10 ** 6])
def test_running_counts_equal_batch(spark, messages, target):
    stream, batch, tmp_path = messages
    root = str(tmp_path / f"counts{target}")
    counters.running_counts(stream, root, target_rows=target).awaitTermination()
    got = spark.read.parquet(f"{root}/counted")
    assert got.select("batch_id").distinct().count() == 4
    assert {(r["event_id"], r["f_msg_count_per_imsi"]) for r in got.collect()} == {
        (r["event_id"], r["f_msg_count_per_imsi"]) for r in message_count(batch).collect()}


@pytest.mark.parametrize("target", [15, 10 ** 6])
def test_threshold_alerts_equal_batch(spark, messages, target):
    stream, batch, tmp_path = messages
    root = str(tmp_path / f"alerts{target}")
    counters.threshold_alerts(stream, root, F.lit(True), "c_imsi", 3, 12, target_rows=target).awaitTermination()
    expected = threshold_windows(batch, F.lit(True), "c_imsi", 3, 12).drop("n_messages")
    found = spark.read.parquet(f"{root}/alerts").select(expected.columns)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in expected.collect()) != []


def test_counts_with_a_hot_key_repeated_batches_and_pauses(spark, tmp_path):
    import random
    from datetime import datetime, timedelta, timezone
    draw, at = random.Random(4), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(900):
        at += timedelta(seconds=draw.choice([0, 1, 1, 3]) if i % 300 else 10_000 * (i > 0))
        rows.append((i, at, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{draw.randrange(40)}"))
    for cuts in ([300, 600], [300, 310, 320, 600]):
        # The pause before row 300 makes all keys start again, the one before row 600 too.
        root = str(tmp_path / str(len(cuts)))
        batches(spark, counters.count_handler(root, idle_seconds=5_000, target_rows=50), rows, cuts)
        found = {r.event_id: r.f_msg_count_per_imsi for r in spark.read.parquet(f"{root}/counted").collect()}
        expected, n = {}, {}
        for i, _, key in rows:
            if i % 300 == 0:
                n = {}
            n[key] = n.get(key, 0) + 1
            expected[i] = n[key]
        assert found == expected


def test_windows_with_a_hot_source_over_batches(spark, tmp_path):
    import random
    from datetime import datetime, timedelta, timezone
    draw, at = random.Random(6), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(600):
        at += timedelta(seconds=draw.choice([0, 0, 1, 2, 9]))
        rows.append((i, at, "hot" if i % 2 else f"k{draw.randrange(5)}"))
    expected = {(r["c_imsi"], r["window_start"], r["alert_at"]) for r in threshold_windows(
        spark.createDataFrame(rows, MESSAGES), F.lit(True), "c_imsi", 4, 20).collect()}
    for target in (25, 10 ** 6):
        root = str(tmp_path / str(target))
        batches(spark, counters.threshold_handler(root, F.lit(True), "c_imsi", 4, 20, target_rows=target), rows, [7, 8, 300, 500])
        found = [(r["c_imsi"], r["window_start"], r["alert_at"]) for r in spark.read.parquet(f"{root}/alerts").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_keyed_table_folds_versions_and_reads_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "key string, n long", "key", buckets=8, every=3)
    assert table.read(5).count() == 0
    latest = {}
    for batch in range(8):
        rows = [(f"k{(batch * 5 + i) % 13}", batch * 100 + i) for i in range(5)]
        latest |= dict(rows)
        for _ in range(2):
            table.write(spark.createDataFrame(rows, "key string, n long"), batch)
        assert {r.key: r.n for r in table.read(batch + 1).collect()} == latest
    assert [v for v in table.versions() if v[1]] == [(2, True), (5, True)]
    assert min(table.versions()) == (2, True)
    # A batch reads what earlier ones left, and of it only its buckets.
    one = spark.createDataFrame([("k1",)], "key string")
    some = table.read(8, one)
    assert {r.key: r.n for r in some.collect()}["k1"] == latest["k1"] and some.count() < len(latest)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Folding forgets what does not meet the condition.
    table.write(spark.createDataFrame([("new", 900)], "key string, n long"), 8, F.col("n") >= 700)
    assert {r.key for r in table.read(9).collect()} == {k for k, n in latest.items() if n >= 700} | {"new"}


def test_streams_share_a_root(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([("1.1.1.1",)], "src_ip string")
    two = spark.createDataFrame([("2.2.2.2",), ("2001:db8::7",), ("1.1.1.1",), ("2001:::7",), ("1:2:3:4:5:6:7:8",),
                                 ("1:2:3:4:5:6:7:8:9",), ("1::2:3:4:5:6:7:8",), ("::",), (":",)], "src_ip string")
    jobs.add_to_blocklist(one, root, "scoring", 0)
    for _ in range(2):
        jobs.add_to_blocklist(two, root, "sip", 0)
    assert {r["ip"] for r in jobs.blocklist(spark, root).collect()} == {"1.1.1.1", "2.2.2.2", "2001:db8::7", "1:2:3:4:5:6:7:8", "::"}
    assert jobs._blocked_by_all(spark, root).count() == 5


def test_stream_columns_go_by_header(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("c_imsi,src_ip\n242011111111100,9.9.9.9\n")
    schema = T.StructType([T.StructField("src_ip", T.StringType()), T.StructField("c_imsi", T.StringType())])
    rows = run(jobs.file_stream(spark, str(inbox), schema), "named", tmp_path).collect()
    assert [tuple(r) for r in rows] == [("9.9.9.9", "242011111111100", "a.csv")]
