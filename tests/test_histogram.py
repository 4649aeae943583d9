from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenkeel.functions import keys
from evenkeel.functions.values import FLOW, counter
from evenkeel.operators import shape
from evenkeel.operators.histogram import Histogram
from evenkeel.operators.sharded import PendingRows, ShardedHistogram
from evenkeel.sources import workload
from evenkeel.streaming import runner

SECRET = bytes(range(16))


def updates(spark, pairs):
    return spark.createDataFrame([(k.encode() if isinstance(k, str) else k, v) for k, v in pairs], "key binary, value bigint")


def single(spark, **more):
    return Histogram(spark, **({"capacity": 256, "z": 4, "secret": SECRET} | more))


def test_fips_vector(spark):
    df = spark.createDataFrame([(bytes.fromhex("00112233445566778899aabbccddeeff"),)], "key binary")
    tag = df.select(keys.aes_tag("key", SECRET)).first()[0]
    assert tag % 2**64 == int.from_bytes(bytes.fromhex("69C4E0D86A7B0430"), "little")
    # Two blocks: the second is zero but for its first two bytes.
    df = spark.createDataFrame([(bytes.fromhex("00112233445566778899aabbccddeeff0102"),)], "key binary")
    tag = df.select(keys.aes_tag("key", SECRET, 32)).first()[0]
    assert tag % 2**64 == int.from_bytes(bytes.fromhex("39DF4C49A3B7B5E7"), "little")


def test_routing(spark):
    df = spark.createDataFrame([(keys.with_leaf(0x7FFF_1234_5678_9ABC, 5, 2),), (-1,), (0,)], "tag bigint")
    rows = df.select(keys.leaf(F.col("tag"), 2), keys.shard(F.col("tag"), 4), keys.is_real(F.col("tag")), keys.node_at_depth(keys.leaf(F.col("tag"), 2), 2, 1)).collect()
    assert rows[0][0] == 5 and rows[0][1] == 0x7FFF1234 & 3 and rows[0][3] == 2
    assert rows[1][0] == 7 and rows[1][1] == 3
    assert not rows[2][2]
    assert keys.eviction_leaves(3, 0, 8) == [8, 12, 10, 14, 9, 13, 11, 15]
    assert [keys.node_depth(n) for n in (1, 2, 3, 4)] == [0, 1, 1, 2] and keys.is_leaf(4, 2)
    order = [r.tag for r in df.orderBy(keys.unsigned_order(F.col("tag"))).collect()]
    assert order == sorted(order, key=lambda t: t % 2**64)


def test_totals_peek_and_pop(spark):
    h = single(spark)
    h.append(updates(spark, [("s", 1), ("s", 2), ("a", 5)]))
    h.append(updates(spark, [("s", 3), ("a\0", 1)]))
    total = lambda k: h.peek_total(k).first().value
    assert total(b"s") == 6 and total(b"never") == 0 and total(b"a") == 6
    assert h.pop_total(b"s").first().value == 6 and h.pop_total(b"s").first().value == 0
    assert h.occupancy() == 1
    h.grow()
    h.append(updates(spark, [("fresh", 7)]))
    assert total(b"a") == 6 and total(b"fresh") == 7 and h.total_capacity == 512


def test_flow_merge(spark):
    rows = [(b"192.168.1.1:8080", 10, 1500, 100, 105, 1, 2), (b"192.168.1.1:8080", 20, 3000, 90, 120, 1, 16)]
    h = single(spark, spec=FLOW)
    h.append(spark.createDataFrame(rows, "key binary, packet_count bigint, byte_sum bigint, first_seen bigint, last_seen bigint, record_count bigint, tcp_flags int"))
    assert tuple(h.peek_total(b"192.168.1.1:8080").first()) == (30, 4500, 90, 120, 2, 0x12)
    assert h.peek_total(b"10.0.0.1:443----").first().packet_count == 0


@pytest.mark.parametrize("key", [None, b"x" * 17])
def test_bad_keys_fail(spark, key):
    h = single(spark)
    h.append(spark.createDataFrame([(key, 1)], "key binary, value bigint"))
    with pytest.raises(PySparkException):
        h.commit()


def test_readouts_agree_and_have_fixed_length(spark):
    rows = [((17 * i + 5 * (i // 11)) % 43, 1) for i in range(503)]
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 0) + v
    h = single(spark)
    assert h.readout().count() == h.readout_len == 576
    h.append(updates(spark, [(k.to_bytes(16, "big"), v) for k, v in rows]))
    real = lambda df: {int.from_bytes(r.key, "big"): r.value for r in df.filter("is_real").collect()}
    first = h.readout()
    assert first.count() == 576 and real(first) == want == real(h.readout()) == real(h.readout_tree_aware())
    ordered = [r for r in first.orderBy("slot").collect()]
    assert all(r.is_real for r in ordered[:43]) and not any(r.is_real for r in ordered[43:])
    assert [r.key for r in ordered[:43]] == sorted(r.key for r in ordered[:43])
    for local, slots in ((1, 2560), (2, 1536), (3, 1024)):
        chunk = h.readout_subtree_partitioned(local)
        assert chunk.count() == slots and real(chunk) == want
    exported = h.export_entries().collect()
    assert [r.key for r in exported] == sorted(r.key for r in exported) and len(exported) == 43
    assert real(h.into_readout_tree_aware()) == want and h.occupancy() == 0


def test_overflows_are_errors(spark):
    h = single(spark, capacity=8, stash=1)
    h.append(updates(spark, [(f"k{i}", 1) for i in range(64)]))
    with pytest.raises(shape.CapacityExceeded):
        h.readout()
    big = single(spark, capacity=32, stash=1)
    big.append(updates(spark, [(f"k{i}", 1) for i in range(600)]))
    with pytest.raises(shape.SubtreeReadoutOverflow) as e:
        big.readout_subtree_partitioned(1)
    assert e.value.max_load > e.value.inbox_len and e.value.subtree_count == 4
    s = ShardedHistogram(spark, 4, 256, 64, quota=8, z=4, secret=SECRET)
    with pytest.raises(shape.QuotaOverflow) as q:
        s.append(updates(spark, [(f"k{i}", 1) for i in range(80)]))
    assert q.value.quota == 8 < q.value.max_load


def test_a_frame_is_flushed_in_batches(spark):
    s = ShardedHistogram(spark, 2, 256, 8, quota=8, z=4, secret=SECRET)
    s.append(updates(spark, [(f"k{i}", 1) for i in range(20)]).coalesce(1))  # 8 keys a batch at most, whatever the frame's size
    assert s.pending == 4 and s._all.occupancy() == 16
    s.append(updates(spark, [(f"k{i}", 1) for i in range(20, 23)]))
    assert s.pending == 7 and s._all.occupancy() == 16
    s.append(updates(spark, [("k0", 5)]))
    assert s.pending == 0 and s.peek_total(b"k0").first().value == 6 and s.occupancy() == 23
    tight = ShardedHistogram(spark, 1, 256, 16, quota=8, z=4, secret=SECRET)
    tight.append(updates(spark, [(f"k{i % 8}", 1) for i in range(48)]).coalesce(1))
    with pytest.raises(shape.QuotaOverflow) as q:
        tight.append(updates(spark, [(f"k{i % 9}", 1) for i in range(48)]).coalesce(1))
    assert (q.value.max_load, q.value.quota) == (9, 8)


def test_flush_step(spark):
    s = ShardedHistogram(spark, 2, 256, 64, z=4, secret=SECRET, step=lambda rows: rows.withColumn("value", F.least("value", F.lit(3))))
    s.append(updates(spark, [("a", 2), ("a", 2), ("b", 1)]))
    s.flush()
    assert s.peek_total(b"a").first().value == 3 and s.peek_total(b"b").first().value == 1
    s.increment_blocks(s.export_entries())
    s.flush()
    assert s.peek_total(b"a").first().value == 6


def test_one_frame_grows_until_it_fits(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(1).cast("bigint").alias("value"))
    for seed in range(3):
        h = single(spark, capacity=64)
        h.enable_auto_resize(32, seed=seed)
        h.append(rows)
        out = h.readout()
        assert out.filter("is_real").count() == 5000 and out.count() == h.readout_len and h.grown >= 4
        assert h.commit().select("epoch").distinct().count() > 3
        grown = h.grown
        h.append(rows)  # no new keys, no growth
        assert h.occupancy() == 5000 and h.grown - grown <= 1
    s = ShardedHistogram(spark, 4, 256, 64, z=4, secret=SECRET)
    s.enable_auto_resize(128, seed=1)
    s.append(rows)
    assert s.readout().filter("is_real").count() == 5000 and s.capacity == 256 << s._all.grown


def test_controller_survives_a_restart():
    from evenkeel.operators.resize import Controller

    one = Controller(100, 4, 20, 8, seed=3)
    one.decide(5, 8)
    one.on_grown(9)
    two = Controller(100, 4, 20, 8, seed=3)
    two.restore(one.save())
    for seen in (3, 900, 40):
        assert one.decide(seen, 9) == two.decide(seen, 9)
    assert one.save() == two.save()


def test_grouping_forms_agree(spark):
    from evenkeel.operators import aggregate

    rows = updates(spark, [(f"k{i % 7}", i) for i in range(100)]).withColumn("at", F.monotonically_increasing_id())
    want = sorted((bytes(r.key), r.value) for r in aggregate.group(rows, counter()).collect())
    assert [(bytes(r.key), r.value) for r in aggregate.sorted_group(rows, counter()).collect()] == want
    for form in (aggregate.last_of_run(rows, "key", {"value": F.sum("value")}), aggregate.last_of_run_in_order(rows, "key", ["at"], {"value": F.sum("value")})):
        assert sorted((bytes(r.key), r.value) for r in form.collect()) == want
    state = aggregate.merge(aggregate.group(rows.filter("value < 50"), counter()), aggregate.group(rows.filter("value >= 50"), counter()), counter())
    assert sorted((bytes(r.key), r.value) for r in state.collect()) == want


def test_ranks_are_complete(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(5)
    got = shape.ranks(rows, [-F.col("v")]).collect()
    assert sorted((r.slot, r.v) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert shape.padded(shape.ranks(rows.filter("v < 3"), [F.col("v")]), 5).count() == 5
    with pytest.raises(shape.CapacityExceeded):
        shape.padded(shape.ranks(rows, [F.col("v")]), 999)


def test_hot_key_takes_one_slot(spark):
    s = ShardedHistogram(spark, 4, 256, 64, quota=16, z=4, secret=SECRET)
    s.append(updates(spark, [("hot", 1)] * 64))
    assert s.pending == 0 and s.peek_total(b"hot").first().value == 64
    assert s.fixed_batch(updates(spark, [("hot", 1)] * 64)).count() == 64


def test_sharded_readouts(spark):
    want = {}
    s = ShardedHistogram(spark, 4, 1024, 64, z=4, secret=SECRET)
    for start in (0, 250, 500):
        part = [((19 * u + u // 7) % 73, 1) for u in range(start, min(start + 250, 701))]
        for k, v in part:
            want[k] = want.get(k, 0) + v
        s.append(updates(spark, [(k.to_bytes(16, "big"), v) for k, v in part]))
    real = lambda df: {int.from_bytes(r.key, "big"): r.value for r in df.filter("is_real").collect()}
    out = s.readout()
    assert out.count() == s.readout_len and real(out) == want == real(s.readout_tree_aware())
    rows = out.orderBy("slot").collect()
    assert [r.is_real for r in rows] == [True] * 73 + [False] * (len(rows) - 73)
    assert {r.shard: 0 for r in s.last_loads.collect()}.keys() == {0, 1, 2, 3}
    parts = {}
    s.into_readout_subtree_partitioned(3, lambda i, df: parts.update({i: real(df)}))
    assert set(parts) == {0, 1, 2, 3} and sum(map(len, parts.values())) == 73
    assert {k: v for p in parts.values() for k, v in p.items()} == want and s.occupancy() == 0


def test_pending_is_flushed_or_refused(spark):
    with ShardedHistogram(spark, 2, 256, 100, z=4, secret=SECRET) as s:
        s.append(updates(spark, [(f"k{i}", 1) for i in range(33)]))
        assert s.pending == 33
    assert s.pending == 0 and s.occupancy() == 33
    with pytest.raises(PendingRows):
        with ShardedHistogram(spark, 2, 256, 100, z=4, secret=SECRET) as s:
            s.append(updates(spark, [("a", 1)]))
            raise ValueError
    with pytest.raises(ValueError):
        ShardedHistogram(spark, 3)


def test_files_by_shard(spark, tmp_path):
    s = ShardedHistogram(spark, 4, 256, 1000, z=4, secret=SECRET)
    s.append(updates(spark, [(f"k{i}", 1) for i in range(40)]))
    s.write_by_shard(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.filter(keys.shard(F.col("tag"), 4) != F.col("shard")).isEmpty()


def test_growth(spark):
    h = single(spark, capacity=512)
    h.enable_auto_resize(200, seed=7)
    height = h.height
    for part in range(3):
        h.append(updates(spark, [(f"c_{i}", i + 1) for i in range(100 * part, 100 * part + 100)]))
        for _ in range(4):
            h.resize_if_due()
    assert h.height > height and h.peek_total(b"c_7").first().value == 8
    still = single(spark, capacity=512)
    still.enable_auto_resize(10_000_000, seed=7)
    still.append(updates(spark, [(f"e_{i}", 1) for i in range(200)]))
    assert not any(still.resize_if_due() for _ in range(3))
    s = ShardedHistogram(spark, 4, 256, 64, z=4, secret=SECRET)
    s.enable_auto_resize(80, seed=1)
    before = s.total_capacity
    for part in range(4):
        s.append(updates(spark, [(f"auto_{i}", 1) for i in range(70 * part, 70 * part + 70)]))
    assert s.total_capacity > before and s.total_capacity == 4 * s.shard_capacity


def test_wrapping_counter(spark):
    h = single(spark, spec=counter(wrap=True))
    h.append(spark.createDataFrame([(b"a", Decimal(2**64 - 1)), (b"a", Decimal(2))], "key binary, value decimal(20,0)"))
    assert h.peek_total(b"a").first().value == 1


def test_stream_restart_and_pop(spark, tmp_path):
    source, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    table = runner.StateTable(spark, state)

    def go(rows):
        updates(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key binary, value bigint").option("maxFilesPerTrigger", 1).parquet(source)
        q = runner.run(stream, lambda: single(spark), table, check)
        q.awaitTermination(120)
        assert q.exception() is None
        return {r.key.rstrip(b"\0"): r.value for r in table.read().collect()}

    assert go([("a", 1), ("b", 2), ("a", 3)]) == {b"a": 4, b"b": 2}
    assert go([("a", 10)]) == {b"a": 14, b"b": 2}
    assert [r.value for r in runner.pop(table, b"a").collect()] == [14]
    assert go([("c", 1)]) == {b"b": 2, b"c": 1}
    # The versions of the last two batches are left, with both of the batch before the removal's.
    assert [(e["batch"], e["turn"]) for e in table.entries()] == [(1, 0), (1, 1), (2, 0)]
    assert len(list((tmp_path / "state").glob("version-*"))) == 3


def test_stream_grows_and_replays_the_same(spark, tmp_path):
    source, state = str(tmp_path / "in"), runner.StateTable(spark, str(tmp_path / "state"), keep=9)

    def make():
        h = single(spark, capacity=64)
        h.enable_auto_resize(32, seed=3)
        return h

    for part in range(3):
        spark.range(400 * part, 400 * part + 600).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(1).cast("bigint").alias("value")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key binary, value bigint").option("maxFilesPerTrigger", 1).parquet(source)
    q = runner.run(stream, make, state, str(tmp_path / "check"))
    q.awaitTermination(180)
    assert q.exception() is None
    h, entries = runner.restored(state, make), state.entries()
    assert [e["batch"] for e in entries] == [0, 1, 2] and entries[0]["grown"] < entries[2]["grown"] == h.grown
    out = h.readout()
    assert out.count() == h.readout_len and out.filter("is_real").agg(F.count(F.lit(1)), F.sum("value")).first() == (1400, 1800)
    # Batch 2 once more, as after a failure before its entry: the same growth, the same rows.
    again = runner.restored(state, make, 2)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    again.append(spark.read.parquet(str(files[-1])))
    rows = lambda frame: sorted((bytes(r.key), r.value, r.epoch) for r in frame.collect())
    assert rows(again.commit()) == rows(h.commit()) and again.save() == {k: entries[2][k] for k in again.save()}


def test_state_of_another_setting_is_refused(spark):
    h = single(spark)
    with pytest.raises(ValueError):
        h.restore(h.commit(), h.save() | {"controller": {}})
    with pytest.raises(ValueError):
        runner.StateTable(spark, "x", keep=1)


def test_workload(spark):
    import numpy as np

    assert int(workload.splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    made = workload.key_bytes(np.arange(100), 5)
    assert len(set(made)) == 100 and all(len(k) == 16 for k in made)
    assert workload.zipf(spark, 500, 50, 1.3).agg(F.max("idx")).first()[0] < 50
    assert workload.quadratic(spark, 500, 64).agg(F.max("idx")).first()[0] < 64
    a, b = bytes(range(16)), bytes(range(16, 32))
    df = spark.createDataFrame([(a, b, a[:4], b[:4])], "s binary, t binary, s4 binary, t4 binary")
    row = df.select(workload.ipv6_key("s", "t"), workload.ipv6_key("t", "s"), workload.ipv4_key("s4", "t4")).first()
    assert bytes(row[0]) == bytes(row[1]) == bytes(x ^ y for x, y in zip(a, b)) and bytes(row[2]) == a[:4] + b[:4] + bytes(8)
