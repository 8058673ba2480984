"""Exact de-duplication, sharding and WARC bundles against brute force."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from sigwatch.llm import exact, sharding, warc

LONG = "long text " * 30000
TEXTS = [(1, "a b"), (2, "a \t\n b"), (3, "a  b "), (4, None), (5, ""), (6, " "), (7, "\x0b\x0c"), (8, LONG), (9, LONG + " "),
         (0, "a b"), (10, "é b"), (11, " "), (None, "a b"), (None, "alone")]
CLASHING = "doc_id long, text string, bucket int, key string, members string, _raw int"


def clashing(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, "k", "m", n) for n, (i, t) in enumerate(texts)], CLASHING)


def groups(texts):
    found = defaultdict(list)
    for i, t in texts:
        found[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return found


@pytest.mark.parametrize("limits", [{}, {"capacity": 100, "max_depth": 6}, {"capacity": 1, "max_depth": 12}])
def test_exact_groups(spark, limits):
    expected = Counter()
    for text, ids in groups(TEXTS).items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    rows = exact.exact_groups(clashing(spark).repartition(3), **limits).collect()
    assert Counter(map(tuple, rows)) == expected


def test_exact_repeated_rows_and_hot_text(spark):
    texts = [(i, "hot") for i in range(3000)] + [(5, "hot"), (5, "other"), (5, "other")]
    frame = clashing(spark, texts).repartition(7)
    rows = exact.exact_groups(frame).collect()
    assert Counter((r.keep_id, r.group_size) for r in rows) == {(0, 3001): 3001, (5, 2): 2}
    assert sum(r.kept for r in rows) == 2
    kept = exact.drop_copies(frame)
    assert kept.schema == frame.schema
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "hot"), (5, "other")]


def test_exact_keeps_rows_whole(spark):
    kept = exact.drop_copies(clashing(spark))
    texts = dict(enumerate(TEXTS))
    for row in kept.collect():
        assert texts[row["_raw"]] == (row.doc_id, row.text) and row.key == "k"
    assert kept.count() == len(groups(TEXTS))
    assert exact.drop_copies(clashing(spark).limit(0)).count() == 0
    assert exact.exact_groups(clashing(spark).limit(0)).count() == 0


def test_entries_of_whole_rows_hold_texts_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(exact, "stored", lambda frame, purpose: made.append(frame) or frame)
    exact.drop_copies(clashing(spark))
    whole = [f for f in made[0].schema.fields if f.dataType.typeName() in ("string", "binary")]
    assert [f.name for f in whole] == ["text", "key", "members"]
    monkeypatch.undo()
    bare = spark.createDataFrame([(2, b"\xff a"), (1, b"\xff  a"), (3, None)], "doc_id long, text binary")
    assert sorted(map(tuple, exact.drop_copies(bare).collect())) == [(1, b"\xff  a"), (3, None)]


def test_colliding_keys_are_chained(spark, monkeypatch):
    batch = exact.pa.RecordBatch.from_pydict({"b": [0] * 4, "k": [7] * 4, "m": [[1], [2], [3], [4]],
                                              "t": [b"x", b"y", b"x ", b"x"]})
    schema = exact.pa.schema([(n, t) for n, t in (
        ("bucket", exact.pa.int64()), ("key", exact.pa.int64()), ("chain", exact.pa.int32()),
        ("digest", exact.pa.string()), ("keep_id", exact.pa.int64()), ("group_size", exact.pa.int64()),
        ("members", exact.pa.list_(exact.pa.int64())), ("first", exact.pa.bool_()))])
    out = [r for b in exact._own("id", "t", ["b", "k", "m"], [], schema)(iter([batch])) for r in b.to_pylist()]
    assert [(r["chain"], r["keep_id"], r["group_size"]) for r in out if r["group_size"]] == [(0, 1, 2), (1, 2, 1), (2, 3, 1)]


def test_directory_splits_only_overfull_buckets():
    sizes = np.array([5, 5, 1, 1, 0, 0, 3, 90])
    depth, directory = exact.grow_directory(sizes, 10)
    assert depth == 3 and directory.tolist() == [0, 0, 2, 2, 4, 4, 6, 7]
    assert exact.grow_directory(sizes, 1000)[0] == 0


def plain_shards(rows, limit):
    """Prefixes grown bit by bit."""
    hashed = [(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), len((t or "").encode()), k) for k, t in rows]
    found, waiting = {}, [("", hashed)]
    while waiting:
        prefix, held = waiting.pop()
        size = sum(h[1] for h in held)
        if size <= limit or len(held) == 1:
            found.update({h[2]: (prefix, len(prefix), size, len(held)) for h in held})
            continue
        for bit in "01":
            side = [h for h in held if f"{h[0]:060b}"[len(prefix)] == bit]
            if side:
                waiting.append((prefix + bit, side))
    return found


@pytest.mark.parametrize("limit", [200, 5000, 1 << 30])
def test_shards_match_bitwise_splitting(spark, limit):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(500)] + [(1000, "y" * 3000), (1001, None)]
    frame = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, shard string, cell int")
    found = {r.doc_id: (r.shard, r.depth, r.shard_bytes, r.shard_rows) for r in sharding.assign_shards(frame, limit=limit).collect()}
    assert found == plain_shards(rows, limit)
    assert sharding.assign_shards(frame.limit(0)).count() == 0


def test_hot_and_null_keys_are_cut(spark, tmp_path):
    rows = [("hot", "x" * 100)] * 600 + [(None, "z" * 100)] * 300 + [(f"k{i}", "y" * 100) for i in range(300)]
    frame = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id string, text string, shard string")
    found = sharding.assign_shards(frame, limit=2000).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, _ in rows)
    held = Counter()
    for r in found:
        held[r.shard] += r.bytes
    assert max(held.values()) <= 2000 and all(held[r.shard] == r.shard_bytes for r in found)
    sharding.write_shards(frame, f"{tmp_path}/out", limit=2000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 1200 and back.select("shard_").distinct().count() == len(held)


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u: v\r\nX: y", ""), (5, "http://b", "é\r\n\r\nWARC/1.1"),
         (6, "http://c", LONG), (7, "http://d", LONG), (None, "http://n", "<p>x</p>"), (None, "http://m", "only"), (2, "http://a/2", "<p>x</p>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "s", 0) for r in rows], "page_id long, url string, html string, sha string, payload int")


@pytest.mark.parametrize("least", [0, 5, 10**6])
def test_archives_round_trip(spark, tmp_path, least):
    index = warc.write_archives(pages(spark), f"{tmp_path}/w", min_revisit_bytes=least, frame_bytes=300, bundle_bytes=400)
    best = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= least:
            best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = Counter()
    for i, url, h in PAGES:
        data = (h or "").encode()
        refers = best.get(h or "", -1)
        revisit = refers >= 0 and (i is None or i < refers)
        expected[i, " ".join((url or "").split()), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                 "revisit" if revisit else "response", refers if revisit else None, None if revisit else data] += 1
    rows = warc.read_archives(index, payloads=True).collect()
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in rows) == expected
    # One record by its frame alone.
    wanted = index.where("page_id = 5")
    assert [r.page_id for r in warc.read_archives(index, only=wanted).collect()] == [5]
    for row in index.collect():
        with open(row.bundle, "rb") as file:
            file.seek(row.frame_start)
            frame = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(row.frame_bytes))
        assert frame[row.offset:row.offset + 8] == b"WARC/1.1"
        headers, _, end = warc.parse_record(frame, row.offset)
        assert end - row.offset == row.length and row.record_id in headers["WARC-Record-ID"]


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(pages(spark).limit(0))).count() == 0
