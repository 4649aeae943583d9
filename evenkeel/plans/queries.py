"""Registered queries: each applies an operator to a whole table, with its DuckDB counterpart beside it.

Updates come from ``events`` (a flow record per user: count, cents, first and last time in microseconds,
flags by event type) and from ``lineitem`` (conversations of supplier and part).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import keys, sizing
from evenkeel.functions.values import CONVERSATION, FLOW, Field, ValueSpec, counter
from evenkeel.operators import aggregate, shape
from evenkeel.operators.histogram import Histogram
from evenkeel.operators.sharded import ShardedHistogram
from evenkeel.sources.scratch import shared_folder
from evenkeel.sources.tables import table
from evenkeel.sources.workload import replayed
from evenkeel.streaming import runner

#: Public parameters of the registered histograms.
CAPACITY, Z, STASH, SHARDS, LOCAL_HEIGHT = 16_384, 16, 64, 4, 7
HEIGHT = sizing.tree_height(CAPACITY, Z)
LENGTH = sizing.readout_len(HEIGHT, Z, STASH)
SECRET = bytes(range(16))
#: Flag of each event type.
FLAGS = {"view": 1, "click": 2, "purchase": 4, "signup": 8, "error": 16}
#: Microseconds since 1970 of a time without zone, whatever the session's zone.
MICROS = "unix_date(cast({0} as date)) * 86400000000L + hour({0}) * 3600000000L + minute({0}) * 60000000L + cast(extract(SECOND FROM {0}) * 1000000 as bigint)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """key and the fields of a flow record, one row per event."""
    return flow_columns(table(spark, sf, "events"))


def flow_columns(rows: DataFrame) -> DataFrame:
    flag = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(n)) for t, n in FLAGS.items()), F.lit(0))
    time = F.expr(MICROS.format("ts"))
    return rows.select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.lit(1).cast("bigint").alias("packet_count"),
        F.round(F.col("value") * 100).cast("bigint").alias("byte_sum"),
        time.alias("first_seen"),
        time.alias("last_seen"),
        F.lit(1).cast("bigint").alias("record_count"),
        flag.alias("tcp_flags"),
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    time = F.expr(MICROS.format("l_shipdate"))
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.lit(1).cast("bigint").alias("frames"), F.col("l_quantity").cast("bigint").alias("bytes"), time.alias("start_ts_us"), time.alias("last_ts_us"))


def histogram(spark: SparkSession, sf: str, spec: ValueSpec = FLOW) -> Histogram:
    h = Histogram(spark, CAPACITY, spec, Z, STASH, secret=SECRET, prf="sha")
    h.append(events(spark, sf))
    return h


def sharded(spark: SparkSession, sf: str, spec: ValueSpec = FLOW) -> ShardedHistogram:
    h = ShardedHistogram(spark, SHARDS, CAPACITY * SHARDS, 1 << 22, spec=spec, z=Z, stash=STASH, secret=SECRET, prf="sha")
    h.append(events(spark, sf))
    h.flush()
    return h


def shown(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*(F.hex(n).alias(n) if n == "key" else F.col(n) for n in names))


FIELDS = FLOW.names
TAIL = ["is_real", "key", *FIELDS]

# DuckDB pieces
CASE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in FLAGS.items()) + " ELSE 0 END"
EVENTS = f"SELECT user_id::varchar AS k, rpad(hex(encode(user_id::varchar)), 32, '0') AS key, round(value * 100)::bigint AS cents, epoch_us(ts) AS t, {CASE} AS f FROM events"
FLOWS = f"SELECT key, count(*) AS packet_count, sum(cents)::bigint AS byte_sum, min(t) AS first_seen, max(t) AS last_seen, count(*) AS record_count, bit_or(f)::int AS tcp_flags FROM ({EVENTS}) GROUP BY key"
TAGGED = f"SELECT *, ('0x' || substr(sha256(unhex(key)), 1, 15))::bigint AS tag FROM ({FLOWS})"
ROUTED = f"SELECT *, ((tag >> 32) & {SHARDS - 1})::int AS shard, tag & 2147483647 AS route FROM ({TAGGED})"
VALUES = ", ".join(FIELDS)


def _grid(rows: str, length: int, extra: str = "") -> str:
    return f"SELECT g.slot, r.key IS NOT NULL AS is_real, r.key, {', '.join('r.' + f for f in FIELDS)}{extra} FROM (SELECT range AS slot FROM range({length})) g LEFT JOIN ({rows}) r ON r.slot = g.slot"


def _group_grid(rows: str, group: str, groups: int, length: int) -> str:
    return f"SELECT (g.n // {length})::int AS {group}, g.n % {length} AS slot, r.key IS NOT NULL AS is_real, r.key, {', '.join('r.' + f for f in FIELDS)} FROM (SELECT range AS n FROM range({groups * length})) g LEFT JOIN (SELECT *, {group}::bigint * {length} + slot AS n FROM ({rows})) r ON r.n = g.n"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT key, count(*) AS n FROM ({EVENTS}) GROUP BY key")
def count_by_key(spark, sf):
    rows = events(spark, sf).select(keys.pad("key").alias("key"), F.col("packet_count").alias("n"))
    return shown(aggregate.group(rows, counter("n")), "key", "n")


@query("SELECT l_suppkey, sum(round(l_extendedprice * 100)::bigint)::bigint AS cents FROM lineitem GROUP BY 1")
def sum_by_key(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    return aggregate.group(rows, counter("cents"), "l_suppkey")


@query(FLOWS)
def flow_record(spark, sf):
    return shown(histogram(spark, sf).commit(), "key", *FIELDS)


CONVERSATIONS = "SELECT l_suppkey, l_partkey, count(*) AS frames, sum(l_quantity::bigint)::bigint AS bytes, min(epoch_us(l_shipdate)) AS start_ts_us, max(epoch_us(l_shipdate)) AS last_ts_us FROM lineitem GROUP BY 1, 2"


def _conversations(rows: DataFrame) -> DataFrame:
    pair = rows.withColumn("pair", F.struct("l_suppkey", "l_partkey")).drop("l_suppkey", "l_partkey")
    return aggregate.group(pair, CONVERSATION, "pair").select("pair.*", *CONVERSATION.names)


@query(CONVERSATIONS)
def conversation_stats(spark, sf):
    return _conversations(conversations(spark, sf))


@query("SELECT l_partkey, max(l_quantity::bigint) AS most, bit_or((1::bigint << (l_linenumber - 1))::int)::int AS seen FROM lineitem GROUP BY 1")
def custom_accumulator(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("most"), F.expr("shiftleft(1, l_linenumber - 1)").alias("seen"))
    return aggregate.group(rows, ValueSpec((Field("most", "max"), Field("seen", "bit_or", 0, "int"))), "l_partkey")


@query("SELECT l_suppkey, (sum(18446744073709551615::hugeint - l_orderkey) % 18446744073709551616::hugeint)::varchar AS total FROM lineitem GROUP BY 1")
def wrapping_sum_u64(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("l_orderkey").cast("decimal(20,0)")).alias("total"))
    return aggregate.group(rows, counter("total", wrap=True), "l_suppkey").select("l_suppkey", F.col("total").cast("string").alias("total"))


@query(FLOWS)
def batched_merge(spark, sf):
    """The stream in batches by event id: merged one after the other, the same totals."""
    rows = table(spark, sf, "events").withColumn("b", F.pmod("event_id", F.lit(3)))
    h = Histogram(spark, CAPACITY, FLOW, Z, STASH, secret=SECRET)
    for b in range(3):
        part = rows.filter(F.col("b") == b)
        h.append(flow_columns(part))
        h.commit()
    return shown(h.commit(), "key", *FIELDS)


@query("SELECT o_custkey, count(*) AS n, min(year(o_orderdate) - 1990)::smallint AS epoch FROM orders GROUP BY 1")
def epoch_min_merge(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.lit(1).cast("bigint").alias("n"), (F.year("o_orderdate") - 1990).cast("smallint").alias("epoch"))
    return aggregate.group(rows, counter("n"), "o_custkey", "epoch")


@query("SELECT o_custkey, total FROM (SELECT o_custkey, sum(round(o_totalprice * 100)::bigint)::bigint AS total FROM orders GROUP BY 1)")
def run_merge(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return aggregate.last_of_run(rows, "o_custkey", {"total": F.sum("cents")})


@query("SELECT c_custkey, rpad(substr(hex(encode(c_name)), 1, 32), 32, '0') AS key FROM customer")
def key_normalise(spark, sf):
    return shown(table(spark, sf, "customer").select("c_custkey", keys.pad("c_name").alias("key")), "c_custkey", "key")


@query()
def aes_tag_route(spark, sf):
    rows = histogram(spark, sf).commit().select("key")
    rows = keys.prepared(rows, "key", SHARDS, SECRET)
    return shown(rows.withColumn("leaf", keys.leaf(F.col("tag"), HEIGHT)).withColumn("real", keys.is_real(F.col("tag"))), "key", "tag", "leaf", "shard", "real")


@query(f"SELECT key, tag, ((route | 2147483648) >> {31 - HEIGHT})::bigint AS leaf FROM ({ROUTED})")
def sha_route_leaf(spark, sf):
    rows = histogram(spark, sf).tagged()
    return shown(rows.withColumn("leaf", keys.leaf(F.col("tag"), HEIGHT)), "key", "tag", "leaf")


@query(f"SELECT key, tag, shard FROM ({ROUTED})")
def sha_route_shard(spark, sf):
    return shown(sharded(spark, sf).routed(), "key", "tag", "shard")


POINT = "7"
POINT_HEX = POINT.encode().ljust(16, b"\0").hex().upper()
DEFAULTS = ", ".join(f"coalesce(max({f.name}), {f.default})::{'int' if f.type == 'int' else 'bigint'} AS {f.name}" for f in FLOW.fields)


@query(f"SELECT {DEFAULTS} FROM ({FLOWS}) WHERE key = '{POINT_HEX}'")
def point_peek(spark, sf):
    return histogram(spark, sf).peek_total(POINT.encode())


@query(f"SELECT {DEFAULTS} FROM ({FLOWS}) WHERE key = 'none'")
def point_absent_default(spark, sf):
    return histogram(spark, sf).peek_total(b"nobody")


@query(f"SELECT * FROM ({FLOWS}) WHERE key <> '{POINT_HEX}'")
def point_pop_rest(spark, sf):
    h = histogram(spark, sf)
    h.pop_total(POINT.encode())
    return shown(h.commit(), "key", *FIELDS)


@query(f"SELECT {DEFAULTS} FROM ({FLOWS}) WHERE key = '{POINT_HEX}'")
def sharded_pop(spark, sf):
    return sharded(spark, sf).pop_total(POINT.encode())


@query(_grid(f"SELECT *, row_number() OVER (ORDER BY key) - 1 AS slot FROM ({FLOWS})", LENGTH))
def readout_padded(spark, sf):
    """The first page where there are more keys than slots, as in its SQL; ``readout_padded_pages`` has all pages."""
    return shown(histogram(spark, sf).readout(0), "slot", *TAIL)


def _pages(order: str, length: int = LENGTH) -> str:
    """SQL of all pages: as many grids of ``length`` as the keys take."""
    return f"SELECT g.n // {length} AS page, g.n % {length} AS slot, r.key IS NOT NULL AS is_real, r.key, {', '.join('r.' + f for f in FIELDS)} FROM (SELECT unnest(range(greatest(1, (SELECT count(DISTINCT user_id) + {length - 1} FROM events) // {length}) * {length})) AS n) g LEFT JOIN (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS n FROM ({ROUTED})) r ON r.n = g.n"


@query(_pages("key"))
def readout_padded_pages(spark, sf):
    """Every key, however many there are."""
    return shown(histogram(spark, sf).readout_pages(), "page", "slot", *TAIL)


@query(_grid(f"SELECT *, 0 AS slot FROM ({FLOWS}) WHERE false", LENGTH))
def readout_empty_padded(spark, sf):
    h = Histogram(spark, CAPACITY, FLOW, Z, STASH, secret=SECRET, prf="sha")
    h.append(events(spark, sf).filter("false"))
    return shown(h.readout(), "slot", *TAIL)


@query(_grid(f"SELECT *, row_number() OVER (ORDER BY route, tag >> 32, key) - 1 AS slot FROM ({ROUTED})", LENGTH))
def readout_route_order(spark, sf):
    """The first page where there are more keys than slots, as in its SQL; ``readout_route_order_pages`` has all pages."""
    return shown(histogram(spark, sf).readout_tree_aware(0), "slot", *TAIL)


@query(_pages("route, tag >> 32, key"))
def readout_route_order_pages(spark, sf):
    return shown(histogram(spark, sf).readout_pages(tree_aware=True), "page", "slot", *TAIL)


@query(_grid(f"SELECT *, row_number() OVER (ORDER BY route, tag >> 32, key) - 1 AS slot FROM ({ROUTED})", LENGTH))
def readout_route_order_consuming(spark, sf):
    """The first page, as in its SQL; keys beyond it stay in the state for the next call."""
    return shown(histogram(spark, sf).into_readout_tree_aware(paged=True), "slot", *TAIL)


CUT = HEIGHT - LOCAL_HEIGHT
COUNT, INBOX, CHUNK = sizing.subtree_sizes(HEIGHT, LOCAL_HEIGHT, Z, STASH, 80)


@query(_group_grid(f"SELECT *, row_number() OVER (PARTITION BY subtree ORDER BY route, tag >> 32, key) - 1 AS slot FROM (SELECT *, (route >> {31 - CUT})::int AS subtree FROM ({ROUTED}))", "subtree", COUNT, CHUNK))
def readout_subtree_chunks(spark, sf):
    """Every key: a subtree that holds more than its chunk has further ones, and so have all. There its SQL lets a subtree's rows run into the next one's slots."""
    return shown(histogram(spark, sf).readout_subtree_partitioned(LOCAL_HEIGHT, chunks=None), "subtree", "slot", *TAIL)


@query(f"SELECT g.range::int AS subtree, count(r.key) AS load FROM range({COUNT}) g LEFT JOIN (SELECT *, route >> {31 - CUT} AS subtree FROM ({ROUTED})) r ON r.subtree = g.range GROUP BY 1")
def subtree_loads(spark, sf):
    rows = histogram(spark, sf).tagged().withColumn("subtree", keys.subtree(F.col("tag"), CUT))
    return shape.loads(rows, "subtree", COUNT)


@query(f"SELECT tag, key, {VALUES} FROM ({TAGGED})")
def export_real_only(spark, sf):
    return shown(histogram(spark, sf).export_entries(), "tag", "key", *FIELDS)


@query(f"SELECT tag, key, {VALUES} FROM ({TAGGED})")
def sharded_export(spark, sf):
    return shown(sharded(spark, sf).export_entries(), "tag", "key", *FIELDS)


@query(f"SELECT g.range::int AS shard, count(r.key) AS load FROM range({SHARDS}) g LEFT JOIN ({ROUTED}) r ON r.shard = g.range GROUP BY 1")
def shard_loads(spark, sf):
    return sharded(spark, sf).last_loads


@query(f"SELECT max(n) AS max_load FROM (SELECT count(*) AS n FROM ({ROUTED}) GROUP BY shard)")
def shard_max_load(spark, sf):
    return sharded(spark, sf).last_loads.agg(F.max("load").alias("max_load"))


QUOTA = 4096


@query(_group_grid(f"SELECT *, row_number() OVER (PARTITION BY shard ORDER BY tag, key) - 1 AS slot FROM ({ROUTED})", "shard", SHARDS, QUOTA))
def routed_quota_grid(spark, sf):
    """Every key: a shard over its quota has further sends, and so have all. There its SQL lets a shard's rows run into the next one's slots."""
    h = ShardedHistogram(spark, SHARDS, CAPACITY * SHARDS, 1 << 22, QUOTA, spec=FLOW, z=Z, stash=STASH, secret=SECRET, prf="sha")
    return shown(h.fixed_batch(events(spark, sf), sends=None), "shard", "slot", *TAIL)


@query(_grid(f"SELECT *, row_number() OVER (ORDER BY shard, key) - 1 AS slot FROM ({ROUTED})", SHARDS * LENGTH))
def sharded_readout(spark, sf):
    return shown(sharded(spark, sf).readout(), "slot", *TAIL)


@query(_group_grid(f"SELECT *, row_number() OVER (PARTITION BY shard ORDER BY route, tag >> 32, key) - 1 AS slot FROM ({ROUTED})", "shard", SHARDS, LENGTH))
def sharded_readout_route_order(spark, sf):
    return shown(sharded(spark, sf).readout_tree_aware(), "shard", "slot", *TAIL)


@query(f"SELECT shard, key, {VALUES} FROM ({ROUTED})")
def sharded_subtree_emit(spark, sf):
    """The real rows that the consuming readout hands out shard by shard."""
    parts: list[DataFrame] = []
    sharded(spark, sf).into_readout_subtree_partitioned(LOCAL_HEIGHT, lambda s, rows: parts.append(rows.filter("is_real").withColumn("shard", F.lit(s))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return shown(rows, "shard", "key", *FIELDS)


LEAVES = keys.eviction_leaves(HEIGHT, 0, 64)


@query(f"SELECT count(*) AS matching FROM ({ROUTED}) WHERE ((route | 2147483648) >> {31 - HEIGHT}) IN ({', '.join(map(str, LEAVES))})")
def matching_leaf_count(spark, sf):
    return aggregate.count_matching(histogram(spark, sf).tagged(), keys.leaf(F.col("tag"), HEIGHT), LEAVES, 0)


@query(f"SELECT count(*) AS matching FROM ({FLOWS}) WHERE packet_count > 10")
def predicate_count(spark, sf):
    return aggregate.count_where(histogram(spark, sf).commit(), F.col("packet_count") > 10)


@query(f"SELECT count(*) AS occupancy FROM ({FLOWS})")
def occupancy(spark, sf):
    return aggregate.occupancy(histogram(spark, sf).commit())


GROWN = sizing.readout_len(HEIGHT + 1, Z, STASH)


@query(f"SELECT page * {GROWN} + slot AS slot, * EXCLUDE (page, slot) FROM ({_pages('key', GROWN)})")
def grow_preserves(spark, sf):
    """Every key: where there are more than the grown readout has slots, ``slot`` runs on through further readouts of its length."""
    h = histogram(spark, sf)
    h.grow()
    rows = h.readout_pages().withColumn("slot", F.col("page") * h.readout_len + F.col("slot"))
    return shown(rows, "slot", *TAIL)


@query(f"SELECT k, n, row_number() OVER (ORDER BY k) - 1 AS slot, n > 60 AS big, coalesce(sum((n > 60)::int) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS mark FROM (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1)")
def compaction_marks(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = shape.ranks(rows, [F.col("k")]).withColumn("big", F.col("n") > 60)
    return shape.prefix_marks(rows, F.col("big"), [F.col("slot")])


SIGNED = "CASE WHEN o_orderkey % 2 = 1 THEN -o_orderkey ELSE o_orderkey END"


@query(f"SELECT o_orderkey, t, row_number() OVER (ORDER BY t < 0, t) - 1 AS slot FROM (SELECT o_orderkey, {SIGNED} AS t FROM orders)")
def unsigned_order(spark, sf):
    """Bit patterns in the order of the unsigned numbers that they are."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(SIGNED).alias("t"))
    return shape.ranks(rows, [keys.unsigned_order(F.col("t"))])


@query("SELECT user_id, n, 2 * (row_number() OVER (ORDER BY user_id) - 1) + 1 AS slot FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def distribute_slots(spark, sf):
    """The inverse of compaction: the rank-th row goes to the slot that a table gives for it."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = shape.ranks(rows, [F.col("user_id")], "rank")
    slots = spark.range(rows.count()).select(F.col("id").alias("rank"), (2 * F.col("id") + 1).alias("slot"))
    return shape.distributed(ranked, slots)


@query(f"SELECT f.key, {', '.join('f.' + n for n in FIELDS)}, e.epoch FROM ({FLOWS}) f JOIN (SELECT rpad(hex(encode(user_id::varchar)), 32, '0') AS key, min(1 + event_id % 2)::int AS epoch FROM events GROUP BY 1) e USING (key)")
def grown_epoch_merge(spark, sf):
    """The events with even numbers before growing, the others after: a key has its earliest epoch."""
    h = Histogram(spark, CAPACITY, FLOW, Z, STASH, secret=SECRET, epoch=1)
    rows = table(spark, sf, "events")
    h.append(flow_columns(rows.filter("event_id % 2 = 0")))
    h.grow()
    h.append(flow_columns(rows.filter("event_id % 2 = 1")))
    return shown(h.commit(), "key", *FIELDS, "epoch").withColumn("epoch", F.col("epoch").cast("int"))


@query(_grid(f"SELECT *, row_number() OVER (ORDER BY shard, key) - 1 AS slot FROM ({ROUTED})", SHARDS * LENGTH))
def sharded_batches(spark, sf):
    """One frame of many batches of 256 updates, each of which has to keep to its quota."""
    h = ShardedHistogram(spark, SHARDS, CAPACITY * SHARDS, 256, spec=FLOW, z=Z, stash=STASH, secret=SECRET, prf="sha")
    h.append(events(spark, sf))
    return shown(h.readout(), "slot", *TAIL)


@query("SELECT o_custkey, bit_xor(o_orderkey)::bigint AS mixed, max(round(o_totalprice * 100)::bigint) AS most FROM orders GROUP BY 1")
def user_merge(spark, sf):
    """Fields merged by aggregate functions that the caller names."""
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("bigint").alias("mixed"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("most"))
    return aggregate.group(rows, ValueSpec((Field("mixed", F.bit_xor), Field("most", F.max))), "o_custkey")


@query("SELECT count(*) AS occupancy FROM (SELECT DISTINCT user_id FROM events)")
def auto_growth_holds_a_frame(spark, sf):
    """A histogram much too small for its one frame grows until the frame's readout fits."""
    h = Histogram(spark, 16, counter("packet_count"), 4, STASH, secret=SECRET, prf="sha")
    h.enable_auto_resize(8, seed=7)
    h.append(events(spark, sf).select("key", "packet_count"))
    return h.readout().filter("is_real").agg(F.count(F.lit(1)).alias("occupancy"))


@query(FLOWS)
def streamed_flow_record(spark, sf):
    """``events`` as a stream, merged batch by batch into versions of a state."""
    return shown(_streamed(spark, sf, FLOW, lambda: Histogram(spark, CAPACITY, FLOW, Z, STASH, secret=SECRET, prf="sha")).commit(), "key", *FIELDS)


def _streamed(spark, sf, spec, make) -> Histogram:
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    # A pattern, as the table may be one file or a folder of files.
    stream = flow_columns(spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf.rstrip('/')}/events.parque[t]"))
    state = runner.StateTable(spark, f"{folder}/state")
    runner.run(stream.select("key", *spec.names), make, state, f"{folder}/checkpoint").awaitTermination()
    return runner.restored(state, make)


@query(f"SELECT row_number() OVER (ORDER BY key) - 1 AS slot, key, packet_count FROM ({FLOWS})")
def streamed_growth(spark, sf):
    """A histogram much too small for the stream grows batch by batch; its readout, without the padding, whose length depends on the growth."""

    def make():
        h = Histogram(spark, 16, counter("packet_count"), 4, STASH, secret=SECRET, prf="sha")
        h.enable_auto_resize(8, seed=7)
        return h

    return shown(_streamed(spark, sf, counter("packet_count"), make).readout().filter("is_real"), "slot", "key", "packet_count")


@query(f"SELECT * FROM ({CONVERSATIONS}) ORDER BY frames DESC, l_suppkey, l_partkey LIMIT 10")
def topk_flows(spark, sf):
    return shape.topk(_conversations(conversations(spark, sf)), "frames", ["l_suppkey", "l_partkey"])


@query("SELECT count(*) AS packets, sum(l_quantity::bigint)::bigint AS bytes, count(DISTINCT (l_suppkey, l_partkey)) AS pairs, count(*) * 1000 // count(DISTINCT (l_suppkey, l_partkey)) AS mean_flow_length_milli FROM lineitem")
def trace_summary(spark, sf):
    # One pre-aggregated row per pair stands for the distinct count.
    pairs = _conversations(conversations(spark, sf))
    total = pairs.agg(F.sum("frames").alias("packets"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("pairs"))
    return total.withColumn("mean_flow_length_milli", F.expr("packets * 1000 div pairs"))


@query("SELECT l_suppkey, l_partkey, 3 * frames AS frames, 3 * bytes AS bytes, start_ts_us, last_ts_us + 200000000 AS last_ts_us FROM (" + CONVERSATIONS + ")")
def multi_pass_replay(spark, sf):
    return _conversations(replayed(conversations(spark, sf), 3, ["start_ts_us", "last_ts_us"]).drop("pass"))


I10 = "SELECT (17 * i + 5 * (i // 11)) % 43 AS key, count(*) AS value FROM (SELECT range AS i FROM range(503)) GROUP BY 1"


@query(I10)
def formula_counts(spark, sf):
    rows = spark.range(503).select(F.expr("(17 * id + 5 * (id div 11)) % 43").alias("key"), F.lit(1).cast("bigint").alias("value"))
    return aggregate.group(rows, counter())


@query()
def dp_growth_trace(spark, sf):
    """The controller's decisions while events arrive in four batches."""
    h = Histogram(spark, 1024, counter("packet_count"), 4, STASH, secret=SECRET)
    h.enable_auto_resize(100, seed=7)
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("packet_count"), F.pmod("event_id", F.lit(4)).alias("b"))
    for b in range(4):
        h.append(rows.filter(F.col("b") == b).drop("b"))
        h.commit()
    return spark.createDataFrame([(i, t["height"], t["k"], t["seen"], t["threshold"], t["grow"]) for i, t in enumerate(h.controller.trace)], "step int, height int, k int, seen bigint, threshold bigint, grow boolean")


#: Binomial terms of each size, summed from either end.
SIZING_SQL = """
WITH p AS (
  SELECT b.range AS batch, m.range AS shards, t.range AS bits FROM (SELECT unnest([1024, 4096, 16384]) AS range) b, (SELECT unnest([4, 16]) AS range) m, (SELECT unnest([40, 80]) AS range) t
), terms AS (
  SELECT n, m, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - k * ln(m) + (n - k) * ln(1 - 1 / m)) AS x
  FROM (SELECT n, m, unnest(range(0, n + 1)) AS k FROM (SELECT DISTINCT batch // 4 AS n, shards::double AS m FROM p UNION SELECT DISTINCT batch, shards FROM p))
), tails AS (
  SELECT n, m, k, sum(x) OVER (PARTITION BY n, m ORDER BY k DESC) AS up, sum(x) OVER (PARTITION BY n, m ORDER BY k) AS down FROM terms
)
SELECT batch::int AS batch, shards::int AS shards, bits::int AS bits,
  (4 * (SELECT min(k) FROM tails WHERE n = batch // 4 AND m = shards AND k >= n // m AND up <= 2.0 ** -(bits + 2) / m))::int AS quota,
  ((SELECT min(k) FROM tails WHERE n = batch AND m = shards AND k >= n // m AND up <= 2.0 ** -81 / m) - (SELECT max(k) FROM tails WHERE n = batch AND m = shards AND k <= n // m AND down <= 2.0 ** -81 / m))::int AS slack
FROM p
"""


@query(SIZING_SQL)
def sizing_table(spark, sf):
    rows = [(b, m, bits, sizing.suggested_per_shard_quota(b, m, bits), sizing.shard_coordination_slack(b // m, m)) for b in (1024, 4096, 16384) for m in (4, 16) for bits in (40, 80)]
    return spark.createDataFrame(rows, "batch int, shards int, bits int, quota int, slack int")
