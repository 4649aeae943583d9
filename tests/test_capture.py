import struct

import pytest
from pyspark.errors import PySparkException

from evenkeel.functions.values import FLOW
from evenkeel.operators.aggregate import group
from evenkeel.sources import capture

A, B = bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])
A6, B6 = bytes(range(16)), bytes(range(16, 32))


def ipv4(source, target, protocol=6, flags=0x12, fragment=0, options=0):
    head = bytes([0x45 + options, 0]) + struct.pack(">HHH", 40, 7, fragment) + bytes([64, protocol, 0, 0]) + source + target + bytes(4 * options)
    return head + bytes(13) + bytes([flags]) + bytes(6)


def ipv6(source, target, flags=0x02):
    return bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", 20, 6, 64) + source + target + bytes(13) + bytes([flags]) + bytes(6)


def ethernet(kind, body, *tags):
    return bytes(12) + b"".join(struct.pack(">HH", t, 5) for t in tags) + struct.pack(">H", kind) + body


def written(folder, name, packets, order="<", magic=0xA1B2C3D4, link=1, tail=b""):
    rows = b"".join(struct.pack(f"{order}4I", s, f, len(p), len(p) + more) + p for s, f, more, p in packets)
    (folder / name).write_bytes(struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link) + rows + tail)
    return str(folder / name)


def test_packets(spark, tmp_path):
    packets = [
        (5, 7, 0, ethernet(0x0800, ipv4(A, B))),
        (6, 8, 100, ethernet(0x0800, ipv4(A, B, options=2, flags=1))),
        (7, 9, 0, ethernet(0x0800, ipv4(A, B, fragment=3, flags=4))),  # no first fragment
        (7, 9, 0, ethernet(0x0800, ipv4(B, A, protocol=17), 0x88A8, 0x8100)),
        (8, 0, 0, ethernet(0x86DD, ipv6(A6, B6))),
        (9, 0, 0, ethernet(0x0806, bytes(28))),  # not IP
        (9, 1, 0, ethernet(0x0800, ipv4(A, B))[:30]),  # an address is cut
        (9, 2, 0, b""),
    ]
    path = written(tmp_path, "one", packets, tail=struct.pack("<4I", 1, 1, 50, 50) + b"cut")
    got = capture.read(spark, path)
    rows = [(r.packet, r.ts_us, r.length, r.version, r.source and bytes(r.source), r.target and bytes(r.target), r.tcp_flags) for r in got.orderBy("packet").collect()]
    assert rows == [
        (0, 5_000_007, 54, 4, A, B, 0x12),
        (1, 6_000_008, 162, 4, A, B, 1),
        (2, 7_000_009, 54, 4, A, B, 0),
        (3, 7_000_009, 62, 4, B, A, 0),
        (4, 8_000_000, 74, 6, A6, B6, 2),
        (5, 9_000_000, 42, None, None, None, 0),
        (6, 9_000_001, 30, None, None, None, 0),
        (7, 9_000_002, 0, None, None, None, 0),
    ]
    assert capture.summary(got).first() == (5, 3, 54 + 162 + 54 + 62 + 74, 3)
    flows = {bytes(r.key): r for r in group(capture.flow_updates(got), FLOW).collect()}
    assert len(flows) == 3
    r = flows[A + B + bytes(8)]
    assert (r.packet_count, r.byte_sum, r.first_seen, r.last_seen, r.tcp_flags) == (3, 270, 5_000_007, 7_000_009, 0x13)


def test_byte_orders_links_and_many_packets(spark, tmp_path, monkeypatch):
    written(tmp_path, "a", [(1, 5000, 0, ipv4(A, B))], ">", 0xA1B23C4D, 101)  # nanoseconds, raw
    written(tmp_path, "b", [(1, 5, 0, bytes(14) + struct.pack(">H", 0x0800) + ipv4(A, B))], "<", link=113)
    written(tmp_path, "c", [], "<")
    (tmp_path / "empty").write_bytes(b"")
    many = capture.PACKETS + 10
    written(tmp_path, "d", [(i, 0, 0, ipv4(A, B)) for i in range(many)], "<", link=101)
    got = capture.read(spark, str(tmp_path))
    assert got.filter("ts_us = 1000005").count() == 2
    last = got.filter("path like '%/d'").agg({"packet": "max", "ts_us": "max", "version": "count"}).first().asDict()
    assert last == {"max(packet)": many - 1, "max(ts_us)": (many - 1) * 1_000_000, "count(version)": many}
    assert capture.summary(got.filter("path like '%/c'")).first() == (0, 0, 0, 0)


@pytest.mark.parametrize("content", [b"\xd4\xc3\xb2\xa1", b"\x0a\x0d\x0d\x0a" + bytes(40), struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 250)])
def test_other_files_are_refused(spark, tmp_path, content):
    (tmp_path / "x").write_bytes(content)
    with pytest.raises(PySparkException):
        capture.read(spark, str(tmp_path / "x")).collect()
