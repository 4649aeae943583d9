"""Packet captures (classic format): a row per packet, and updates of flow records from it.

A capture has no marks to split it at, so a file is read by one task; Spark packs small files up to
``spark.sql.files.maxPartitionBytes`` into a task and refuses files beyond 2 GB: cut captures while they
are recorded. The headers' lengths are followed packet by packet, all fields are taken for many at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources.workload import ipv4_key, ipv6_key

#: Fixed values of the format: magic number (as read) by byte order and by the time's fractions of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}
#: Where the protocol number stands by link type (raw packets have none); tags of virtual networks; protocols.
LINKS = {1: 12, 113: 14, 101: -2}
TAGS, IPV4, IPV6, TCP = (0x8100, 0x88A8, 0x9100), 0x0800, 0x86DD, 6
PACKETS = 1 << 16

SCHEMA = "path string, packet long, ts_us long, length long, version int, source binary, target binary, tcp_flags int"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, packet (its number in the file), ts_us, length (on the wire), version (4, 6 or null), source, target, tcp_flags.

    Packets that aren't IP or whose address is cut have null in version, source and target; flags are 0 but
    for TCP packets that start a datagram. A last packet that is cut short in its header or body is left out.
    Empty files have no packets; other formats and link types are a ``ValueError``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_rows, SCHEMA)
    known = F.col("version") > 0
    return rows.withColumns({c: F.when(known, F.col(c)) for c in ("version", "source", "target")})


def flow_updates(packets: DataFrame) -> DataFrame:
    """key and the fields of ``values.FLOW`` of all packets with addresses."""
    key = F.when(F.col("version") == 4, ipv4_key("source", "target")).otherwise(ipv6_key("source", "target"))
    one = F.lit(1).cast("bigint")
    return packets.filter("version is not null").select(
        key.alias("key"), one.alias("packet_count"), F.col("length").alias("byte_sum"), F.col("ts_us").alias("first_seen"), F.col("ts_us").alias("last_seen"), one.alias("record_count"), "tcp_flags"
    )


def summary(packets: DataFrame) -> DataFrame:
    """One row: parsed and skipped packets, bytes of the parsed ones, pairs of addresses."""
    pairs = packets.groupBy("version", "source", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    known = F.col("version").isNotNull()
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0).cast("bigint"))
    return pairs.agg(total("n", known).alias("parsed"), total("n", ~known).alias("skipped"), total("bytes", known).alias("bytes"), F.count_if(known).alias("pairs"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content")):
            yield from _packets(path.as_py(), content.as_buffer())


def _packets(path: str, raw: pa.Buffer) -> Iterator[pa.RecordBatch]:
    view, size = memoryview(raw), raw.size
    order, second = MAGIC.get(bytes(view[:4]), ("", 0))
    if not order or size < 24:
        raise ValueError(f"{path}: not a capture of the classic format")
    link = struct.unpack_from(f"{order}I", view, 20)[0] & 0xFFFF
    if link not in LINKS:
        raise ValueError(f"{path}: link type {link} isn't known")
    header, at, done = struct.Struct(f"{order}4I"), 24, 0
    while at < size:
        found = []
        while len(found) < PACKETS and at + 16 <= size:
            seconds, fraction, held, length = header.unpack_from(view, at)
            if at + 16 + held > size:
                break
            found.append((seconds * 1_000_000 + fraction * 1_000_000 // second, at + 16, held, length))
            at += 16 + held
        if not found:
            return
        yield _fields(path, done, np.frombuffer(raw, np.uint8), LINKS[link], *np.array(found, np.int64).T)
        done += len(found)


def _fields(path: str, done: int, data: np.ndarray, kind: int, time: np.ndarray, start: np.ndarray, held: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    n = len(start)

    def take(offset: np.ndarray, width: int) -> np.ndarray:
        """``width`` bytes of each packet; zeros beyond its end."""
        place = offset[:, None] + np.arange(width)
        return np.where(place < held[:, None], data[np.minimum(start[:, None] + place, len(data) - 1)], 0)

    def number(offset: np.ndarray) -> np.ndarray:
        two = take(offset, 2).astype(np.int64)
        return two[:, 0] << 8 | two[:, 1]

    where = np.full(n, kind, np.int64)
    if kind >= 0:
        for _ in range(2):
            where = where + 4 * np.isin(number(where), TAGS)
        protocol = number(where)
    ip = where + 2
    version = take(ip, 1)[:, 0].astype(np.int64) >> 4
    four, six = version == 4, version == 6
    if kind >= 0:
        four, six = four & (protocol == IPV4), six & (protocol == IPV6)
    four, six = four & (held >= ip + 20), six & (held >= ip + 40)
    width = np.where(four, 4, np.where(six, 16, 0))
    inside = np.arange(16) < width[:, None]
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int32))
    source, target = (
        pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(take(ip + np.where(four, v4, v6), 16)[inside].tobytes())]) for v4, v6 in ((12, 8), (16, 24))
    )
    # The flags are in the first fragment, behind a header of 4 * ihl or 40 bytes.
    tcp = (four & (take(ip + 9, 1)[:, 0] == TCP) & (number(ip + 6) & 0x1FFF == 0)) | (six & (take(ip + 6, 1)[:, 0] == TCP))
    behind = ip + np.where(four, 4 * (take(ip, 1)[:, 0].astype(np.int64) & 15), 40)
    flags = np.where(tcp, take(behind + 13, 1)[:, 0], 0)
    columns = [pa.array([path] * n), pa.array(np.arange(done, done + n)), pa.array(time), pa.array(length), pa.array(np.where(four, 4, np.where(six, 6, 0)).astype(np.int32)), source, target, pa.array(flags.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["path", "packet", "ts_us", "length", "version", "source", "target", "tcp_flags"])
