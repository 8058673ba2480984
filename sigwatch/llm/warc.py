"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames, so any record is read by decompressing one frame.
A bundle ends with a seek table in a skippable frame: the compressed and decompressed size of
each frame, their number, and the closing magic number. The index table maps each record to
bundle, frame and the offset inside the decompressed frame.

Executors write bundles straight into the shared folder, each attempt of a task under names of
its own, and the index lists what the successful attempts wrote; bundles of lost attempts are
never read. A task holds one frame and one record at a time. Of records with equal payloads the
one with the largest id is a response, the others are revisits that refer to it; the winner per
digest comes from one aggregation with map-side maxima, and the join back is left to skew
splitting. Payloads below ``min_revisit_bytes`` are all responses.

A null payload is empty, a null url an empty target. A null id is written as "null", comes
before all others and is read back as null. Repeated rows each get a record; of rows that repeat
the largest id with one payload all are responses. No rows give no bundles and no records.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct as packing
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sigwatch.llm.common import stored, struct
from sigwatch.session import shared_dir

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

_INDEX = struct(("page_id", T.LongType()), ("record_id", T.StringType()), ("bundle", T.StringType()),
                ("frame", T.IntegerType()), ("frame_start", T.LongType()),
                ("frame_bytes", T.LongType()), ("offset", T.LongType()), ("length", T.LongType()))
_RECORD = struct(("page_id", T.LongType()), ("record_id", T.StringType()), ("url", T.StringType()),
                 ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()),
                 ("record_type", T.StringType()), ("refers_to", T.LongType()),
                 ("payload", T.BinaryType()))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, record_id: str, url: str, payload: bytes, refers_to) -> bytes:
    """One record. A revisit has no block; the payload's size and digest stay in its header."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {' '.join(url.split())}",
            f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
            f"X-Payload-Bytes: {len(payload)}",
            f"X-Page-ID: {'null' if page_id is None else page_id}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                   for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return headers, data[start:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(packing.pack("<II", *frame) for frame in frames)
    body += packing.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return packing.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int]]:
    """Compressed and decompressed size of each frame, from the end of an open bundle."""
    file.seek(size - 9)
    count, _, magic = packing.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    return list(packing.iter_unpack("<II", file.read(8 * count)))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:")
                                    else f"file://{path}")


class _Bundle:
    """Collects records into frames and frames into one file."""

    def __init__(self, folder: str):
        import zstandard
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{folder}/{name}"
        self.file = files.open_output_stream(posixpath.join(root, name), compression=None)
        self.frames, self.at, self.open, self.rows, self.open_bytes = [], 0, [], [], 0

    def add(self, page_id, record_id, record: bytes) -> None:
        self.rows.append((page_id, record_id, self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)

    def cut(self) -> list[tuple]:
        """Write the open frame; index rows of its records."""
        if not self.open:
            return []
        packed = self.press.compress(b"".join(self.open))
        self.file.write(packed)
        rows = [(page_id, record_id, self.path, len(self.frames), self.at, len(packed), offset, length)
                for page_id, record_id, offset, length in self.rows]
        self.frames.append((len(packed), self.open_bytes))
        self.at += len(packed)
        self.open, self.rows, self.open_bytes = [], [], 0
        return rows

    def close(self) -> None:
        self.file.write(seek_table(self.frames))
        self.file.close()


def _write(folder: str, frame_bytes: int, bundle_bytes: int, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None

        def index(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for page_id, url, payload, refers_to in zip(
                    *(batch.column(i).to_pylist() for i in range(4))):
                if bundle is None:
                    bundle = _Bundle(folder)
                record_id = str(uuid.uuid4())
                bundle.add(page_id, record_id, record_bytes(page_id, record_id, url or "", payload or b"",
                                                            refers_to))
                if bundle.open_bytes >= frame_bytes:
                    yield index(bundle.cut())
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if bundle is not None:
            if rows := bundle.cut():
                yield index(rows)
            bundle.close()
    return write


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0,
                   frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every row as a record; the index of the records, itself on the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_schema

    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    winners = (rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha")
               .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
               # A payload that occurs once needs no partner, so it stays out of the join.
               .where("copies > 1").select("sha", "response"))
    records = rows.join(winners, "sha", "left").select(
        "page_id", "url", "payload",
        F.when(F.coalesce(F.col("page_id") < F.col("response"), F.col("response").isNotNull()
                          & F.col("page_id").isNull()), F.col("response")).alias("refers_to"))
    return stored(records.mapInArrow(
        _write(folder, frame_bytes, bundle_bytes, to_arrow_schema(_INDEX)), _INDEX), "warc-index")


def _records(data: bytes, offsets: list[int] | None, wanted: bool) -> Iterator[tuple]:
    at = 0
    while at < len(data) if offsets is None else offsets:
        if offsets is not None:
            at = offsets.pop(0)
        headers, block, at = parse_record(data, at)
        revisit = headers["WARC-Type"] == "revisit"
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (base32_sha1(block) != digest or len(block) != int(headers["X-Payload-Bytes"])):
            raise ValueError("a payload differs from its digest")
        page_id = headers["X-Page-ID"]
        yield (None if page_id == "null" else int(page_id),
               headers["WARC-Record-ID"].removeprefix("<urn:uuid:").removesuffix(">"),
               headers["WARC-Target-URI"], int(headers["X-Payload-Bytes"]), digest,
               headers["WARC-Type"], int(headers["X-Refers-To-Page-ID"]) if revisit else None,
               block if wanted and not revisit else None)


def _read(wanted: bool, schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for batch in batches:
            for path, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, name = opened(path)
                size, at = files.get_file_info(name).size, 0
                with files.open_input_file(name) as file:
                    want = None
                    if offsets is not None:
                        want = {}
                        for item in offsets:
                            want.setdefault(item["frame"], []).append(item["offset"])
                    for number, (packed, length) in enumerate(read_seek_table(file, size)):
                        if want is None or number in want:
                            file.seek(at)
                            data = zstandard.ZstdDecompressor().decompress(
                                file.read(packed), max_output_size=length)
                            rows = list(_records(data, want and sorted(want[number]), wanted))
                            if rows:
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(v, f.type) for v, f in zip(zip(*rows), schema)],
                                    schema=schema)
                        at += packed
    return read


def read_archives(index: DataFrame, payloads: bool = False, only: DataFrame | None = None) -> DataFrame:
    """The records of the bundles that ``index`` lists, one task per group of bundles.

    With ``only`` (a column record_id) just their frames are fetched and decompressed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if only is None:
        bundles = index.select("bundle").distinct().withColumn(
            "offsets", F.lit(None).cast("array<struct<frame:int,offset:bigint>>"))
    else:
        # A bundle's size bounds how many of its records can be asked for.
        bundles = (index.join(only.select("record_id").distinct(), "record_id", "left_semi")
                   .groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("offsets")))
    # Bundles are few next to rows; plain repartitioning spreads their names over the tasks.
    return (bundles.repartition(bundles.sparkSession.sparkContext.defaultParallelism, "bundle")
            .mapInArrow(_read(payloads, to_arrow_schema(_RECORD)), _RECORD))
