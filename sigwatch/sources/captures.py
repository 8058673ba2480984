"""Packet capture files as a table of source address and payload.

A capture cannot be entered in the middle, so reading takes two steps: a pass over record
headers, which skips the packet bytes, cuts each file into chunks of a fixed number of
packets; then all chunks are parsed by separate tasks. One huge file is thus shared by the
whole cluster, and no task holds more than one packet batch.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

PACKETS = "path string, packet_no bigint, src_ip string, hex_payload string"
_CHUNKS = "path string, start bigint, first_no bigint, packets int, layout string"

# File formats: magic number, byte order and the fixed header lengths.
_CLASSIC = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<",
            b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}
_SECTION = b"\x0a\x0d\x0d\x0a"
_FILE_HEADER, _RECORD_HEADER = 24, 16
_INTERFACE_BLOCK, _PACKET_BLOCK, _SIMPLE_BLOCK = 1, 6, 3
# Bytes before the network header by link type: none, Ethernet, raw IP, Linux cooked.
_NULL, _ETHERNET, _RAW, _COOKED = 0, 1, (12, 101, 228, 229), 113


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _Reader:
    """Positions of packets in one file: (offset, length, link type)."""

    def __init__(self, file, start: int = 0, layout: str = ""):
        self.file, self.at, self.layout = file, start, layout
        self.size = file.size()
        if not layout:
            self._begin()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _begin(self) -> None:
        magic = self._read(0, 4)
        if magic in _CLASSIC:
            order = _CLASSIC[magic]
            link = struct.unpack(order + "I", self._read(20, 4))[0] & 0xFFFF
            self.at, self.layout = _FILE_HEADER, f"classic {order} {link}"
        elif magic == _SECTION:
            self.layout = "blocks < "
        else:
            self.at, self.layout = self.size, "none < "

    def packets(self) -> Iterator[tuple[int, int, int, int, str]]:
        """(record start, data offset, data length, link type, layout before the record)."""
        kind, order, links = self.layout.split(" ", 2)
        if kind == "classic":
            link = int(links)
            while self.at + _RECORD_HEADER <= self.size:
                length = struct.unpack(order + "I", self._read(self.at + 8, 4))[0]
                data = self.at + _RECORD_HEADER
                if data + length > self.size:
                    return  # cut off while being written
                yield self.at, data, length, link, self.layout
                self.at = data + length
        elif kind == "blocks":
            known = [int(x) for x in links.split(",") if x]
            while self.at + 12 <= self.size:
                head = self._read(self.at, 28)
                if head[:4] == _SECTION:
                    order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
                    known = []
                kind_no, total = struct.unpack(order + "II", head[:8])
                if total < 12 or self.at + total > self.size:
                    return
                before = f"blocks {order} {','.join(map(str, known))}"
                if kind_no == _INTERFACE_BLOCK:
                    known.append(struct.unpack(order + "H", head[8:10])[0])
                elif kind_no == _PACKET_BLOCK and len(head) >= 28:
                    interface, length = (struct.unpack(order + "I", head[8:12])[0],
                                         struct.unpack(order + "I", head[20:24])[0])
                    link = known[interface] if interface < len(known) else _ETHERNET
                    yield self.at, self.at + 28, min(length, total - 32), link, before
                elif kind_no == _SIMPLE_BLOCK:
                    length = struct.unpack(order + "I", head[8:12])[0]
                    link = known[0] if known else _ETHERNET
                    yield self.at, self.at + 12, min(length, total - 16), link, before
                self.at += total


def source_address(packet: bytes, link: int) -> str | None:
    """Source address of the network header; None when the packet is not IP."""
    if link == _ETHERNET:
        at, kind = 14, packet[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            at, kind = at + 4, packet[at + 2:at + 4]
        if kind not in (b"\x08\x00", b"\x86\xdd"):
            return None
    elif link == _COOKED:
        at = 16
    elif link == _NULL:
        at = 4
    elif link in _RAW:
        at = 0
    else:
        return None
    version = packet[at] >> 4 if len(packet) > at else 0
    if version == 4 and len(packet) >= at + 20:
        return str(ipaddress.IPv4Address(packet[at + 12:at + 16]))
    if version == 6 and len(packet) >= at + 40:
        return str(ipaddress.IPv6Address(packet[at + 8:at + 24]))
    return None


def _index(chunk_packets: int, limit: int | None):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with _open(path) as file:
                    rows, current, number = [], None, 0
                    for start, _, _, _, layout in _Reader(file).packets():
                        if limit is not None and number >= limit:
                            break
                        if number % chunk_packets == 0:
                            if current:
                                rows.append(current)
                            current = [path, start, number, 0, layout]
                        current[3] += 1
                        number += 1
                    if current:
                        rows.append(current)
                yield pd.DataFrame(rows, columns=["path", "start", "first_no", "packets", "layout"])
    return index


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "packet_no", "src_ip", "hex_payload"]
    for pdf in batches:
        for chunk in pdf.itertuples():
            rows = []
            with _open(chunk.path) as file:
                reader = _Reader(file, chunk.start, chunk.layout)
                found = zip(range(chunk.packets), reader.packets())
                for i, (_, data, length, link, _) in found:
                    packet = reader._read(data, length)
                    rows.append((chunk.path, chunk.first_no + i, source_address(packet, link),
                                 packet.hex()))
            yield pd.DataFrame(rows, columns=columns)


def read_packets(spark: SparkSession, path: str, limit: int | None = None,
                 chunk_packets: int = 2_000, pattern: str = "*.pcap*") -> DataFrame:
    """Packets of all capture files; a caller may ask for the first ``limit`` of each file.

    Packets that are not IP keep their row with a null address.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(path).select("path"))
    chunks = files.repartition(F.col("path")).mapInPandas(_index(chunk_packets, limit), _CHUNKS)
    spread = chunks.repartition(F.col("path"), F.col("first_no"))
    return spread.mapInPandas(_parse, PACKETS)
