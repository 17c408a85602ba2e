"""Packet captures: reading and writing of capture files, TCP streams put together, and the HTTP requests in them.

A capture is a row (path, content) as Spark's binaryFile source gives it, from any store that
Spark reads; one file is parsed by one task, so rotate captures at a bounded size.  What is
parsed: classic captures of either byte order, in micro- or nanoseconds, of Ethernet (with
VLAN tags) or raw IP; IPv4 and IPv6; TCP.  Other packets and fragments that don't begin
a datagram are left out, a packet that the file's end cuts off ends its capture.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import LARGE_ROWS, bounded_batches, stored

PACKETS = "path string, ts timestamp, src string, src_port int, dst string, dst_port int, seq long, flags int, payload binary"
FLOW = ["src", "src_port", "dst", "dst_port"]
SYN = 2
#: Packets in a batch that a parser hands on.
BATCH = 1000

# The formats of the headers.
MAGIC_MICRO, MAGIC_NANO = 0xA1B2C3D4, 0xA1B23C4D
ETHERNET, RAW_IP = 1, 101
IPV4, IPV6, VLAN, TCP = 0x0800, 0x86DD, 0x8100, 6


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the capture files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(folder).select("path", "content")


def frames_of(content: bytes, path: str = "") -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, link type, frame) of every whole packet; ValueError if it isn't a capture."""
    order = next((o for o in "<>" if len(content) >= 24 and struct.unpack_from(o + "I", content)[0] in (MAGIC_MICRO, MAGIC_NANO)), None)
    if order is None:
        raise ValueError(f"not a capture file: {path}")
    fine = 1000 if struct.unpack_from(order + "I", content)[0] == MAGIC_NANO else 1
    link = struct.unpack_from(order + "I", content, 20)[0] & 0xFFFF
    at = 24
    while at + 16 <= len(content):
        seconds, part, size, _ = struct.unpack_from(order + "IIII", content, at)
        at += 16
        if at + size > len(content):
            return
        yield seconds * 1_000_000 + part // fine, link, content[at : at + size]
        at += size


@lru_cache(1 << 14)
def shown(address: bytes) -> str:
    return str(ipaddress.ip_address(address))


@lru_cache(1 << 14)
def packed(address: str) -> bytes:
    return ipaddress.ip_address(address).packed


def tcp_of(link: int, frame: bytes) -> tuple[str, int, str, int, int, int, bytes] | None:
    """src, src_port, dst, dst_port, seq, flags, payload of a TCP packet; None for anything else."""
    at = 0
    if link == ETHERNET:
        if len(frame) < 14:
            return None
        kind, at = struct.unpack_from(">H", frame, 12)[0], 14
        while kind == VLAN and len(frame) >= at + 4:
            kind, at = struct.unpack_from(">H", frame, at + 2)[0], at + 4
    elif link == RAW_IP and frame:
        kind = IPV4 if frame[0] >> 4 == 4 else IPV6
    else:
        return None
    if kind == IPV4 and len(frame) >= at + 20:
        size, whole, fragment, protocol = (frame[at] & 15) * 4, *struct.unpack_from(">H", frame, at + 2), *struct.unpack_from(">H", frame, at + 6), frame[at + 9]
        src, dst, end, first = frame[at + 12 : at + 16], frame[at + 16 : at + 20], at + whole, not fragment & 0x1FFF
    elif kind == IPV6 and len(frame) >= at + 40:
        size, whole, protocol, first = 40, struct.unpack_from(">H", frame, at + 4)[0], frame[at + 6], True
        src, dst, end = frame[at + 8 : at + 24], frame[at + 24 : at + 40], at + 40 + whole
    else:
        return None
    tcp = at + size
    if protocol != TCP or not first or len(frame) < tcp + 20:
        return None
    src_port, dst_port, seq = struct.unpack_from(">HHI", frame, tcp)
    body = tcp + (frame[tcp + 12] >> 4) * 4
    # Ethernet fills up short frames, so the datagram's own length counts
    return shown(src), src_port, shown(dst), dst_port, seq, frame[tcp + 13], frame[body : min(end, len(frame))]


def packets(captures: DataFrame) -> DataFrame:
    """The TCP packets of (path, content), in the order of each file."""
    bounded_batches(captures.sparkSession)
    names = [c.split()[0] for c in PACKETS.split(", ")]
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for us, link, frame in frames_of(content.as_py() or b"", path):
                    if found := tcp_of(link, frame):
                        rows.append((path, us, *found))
                    if len(rows) == BATCH:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return captures.select("path", "content").mapInArrow(run, PACKETS)


def capture_of(rows: list[dict]) -> bytes:
    """A capture of IPv4 packets: us, src, src_port, dst, dst_port, seq, flags, payload of each."""
    out = [struct.pack("<IHHiIII", MAGIC_MICRO, 2, 4, 0, 0, 65535, ETHERNET)]
    for r in rows:
        tcp = struct.pack(">HHIIBBHHH", r["src_port"], r["dst_port"], r["seq"], 0, 5 << 4, r["flags"], 65535, 0, 0) + (r["payload"] or b"")
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, TCP, 0, packed(r["src"]), packed(r["dst"]))
        frame = bytes(12) + struct.pack(">H", IPV4) + ip + tcp
        out.append(struct.pack("<IIII", *divmod(r["us"], 1_000_000), len(frame), len(frame)) + frame)
    return b"".join(out)


def captured(packets: DataFrame, most: int = 2000) -> DataFrame:
    """path, content: captures of at most `most` packets (us, src, src_port, dst, dst_port, seq, flags, payload) each, partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = batch.to_pylist()
            for lo in range(0, len(rows), most):
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{n}.pcap"]), pa.array([capture_of(rows[lo : lo + most])], pa.binary())], ["path", "content"])
                n += 1

    return packets.mapInArrow(run, "path string, content binary")


def kept(captures: DataFrame) -> DataFrame:
    """The captures from a table in the shared folder, whose readers hold a few files at a time, however many there are."""
    return stored(captures, **LARGE_ROWS)


class Requests:
    """Cuts a stream of bytes into HTTP/1.x requests: a head, and as many bytes of a body as it says."""

    def __init__(self, most: int):
        self.most, self.held, self.skip, self.lost = most, bytearray(), 0, False

    def feed(self, data: bytes) -> Iterator[bytes]:
        while data or self.held:
            if self.skip:  # the rest of a request that is too large
                n = min(self.skip, len(data))
                self.skip, data = self.skip - n, data[n:]
                if self.skip:
                    return
            self.held += data
            data = b""
            head = self.held.find(b"\r\n\r\n")
            if head < 0:
                if len(self.held) > self.most:
                    # no request begins here: what follows can't be told apart any more
                    self.held.clear()
                    self.lost = True
                return
            size = head + 4 + self.length(bytes(self.held[:head]))
            if size - head - 4 > self.most:
                self.skip, data = max(0, size - len(self.held)), bytes(self.held[size:])
                self.held.clear()
                continue
            if len(self.held) < size:
                return
            request, data = bytes(self.held[:size]), bytes(self.held[size:])
            self.held.clear()
            if not self.lost:
                yield request
            self.lost = False

    def gap(self) -> None:
        """Bytes are missing: what was begun is given up."""
        self.held.clear()
        self.skip, self.lost = 0, False

    @staticmethod
    def length(head: bytes) -> int:
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value)
        return 0


def requests_in(packets: DataFrame, port: int = 80, most: int = 10 << 20) -> DataFrame:
    """src, src_port, dst, dst_port, nth, ts, request: the whole HTTP requests to the port, stream by stream.

    Segments may come out of order, twice, or overlapping: a stream's bytes are ordered by their
    distance from its first one (its SYN's, or else the smallest number seen, so that only
    streams with a SYN may wrap around).  Where bytes are missing, the request there is left out, and
    so are requests whose body is larger than `most`.  ts is that of the segment that
    completes a request.  Streams are sorted by Spark and read through, so a task holds one
    request at a time, however long a stream is.
    """
    spark = packets.sparkSession
    own = packets.filter(F.col("dst_port") == port)
    syn = F.col("flags").bitwiseAND(SYN) > 0
    first = own.groupBy(*FLOW).agg(F.coalesce(F.max(F.when(syn, F.pmod(F.col("seq") + 1, F.lit(1 << 32)))), F.min("seq")).alias("_first"))
    first = first.select(F.struct(*FLOW).alias("_flow"), "_first")
    data = own.filter(F.length("payload") > 0).select(*FLOW, "ts", "payload", (F.col("seq") + F.when(syn, 1).otherwise(0)).alias("seq"), F.struct(*FLOW).alias("_own"))
    placed = data.join(first, F.col("_own") == F.col("_flow")).withColumn("at", F.pmod(F.col("seq") - F.col("_first"), F.lit(1 << 32))).select(*FLOW, "at", "ts", "payload")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(many, *FLOW).sortWithinPartitions(*FLOW, "at", F.desc(F.length("payload")), "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, parser, end, nth = None, Requests(most), 0, 0
        for batch in batches:
            rows = []
            for *key, at, ts, payload in zip(*(batch.column(c).to_pylist() for c in (*FLOW, "at", "ts", "payload"))):
                if key != flow:
                    flow, parser, end, nth = key, Requests(most), 0, 0
                if at > end:
                    parser.gap()
                    end = at
                fresh = payload[end - at :]
                end += len(fresh)
                for request in parser.feed(fresh) if fresh else ():
                    rows.append((*key, nth, ts, request))
                    nth += 1
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [*FLOW, "nth", "ts", "request"])

    return ordered.mapInArrow(run, "src string, src_port int, dst string, dst_port int, nth long, ts timestamp, request binary")
