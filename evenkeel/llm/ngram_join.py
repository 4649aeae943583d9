"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: by how often the corpus has them, rare ones first, then by hash. Counts
are kept in a table of fixed size (``CELLS``); several n-grams may share a cell, which changes the order
for all texts alike. Sets hold two hashes of each n-gram, 128 bits together.

1. Texts with equal sets are one class, its smallest id stands for it.
2. Candidates. Linked sets of sizes n and m have ``least`` elements in common, so the first of these in the
   order is among the n - least + 1 first ones of the one and the m - least + 1 first ones of the other:
   each set is dealt by its first elements, with their places. What sets have in common with very many
   others comes last in the order, so passages that many documents share bring no candidates.
3. Overlaps. The order is cut into ``PARTS`` fragments, the sets of a pair into these, the common n-grams of
   each fragment are counted separately, and the counts summed by pair.
4. Of the sets that share an element, the one whose place is first (the closest to what the others are
   copies of) is the hub that the others are paired with: a group of m copies costs m pairs. Where members
   of a group are in different components afterwards, more hubs follow, ``MORE`` times as many in each
   round, picked by hash, for pairs of different components only, until all members were hubs or the
   group is one component. So no pair of different components that could be linked is missed.

Null and empty texts have the empty set and are linked with nothing. Rows with a null id have a null
component. Rows with the same id count as one document: it is linked if one of its texts is. Work goes by
nodes, which are pairs of id and text: a node is its id, or a number of its own where several rows have the
id; repeated rows are one node and enter once. Texts are read whole, however long. An empty table gives no
rows; further columns are ignored, whatever their names. Ids must be integers (``TypeError``).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evenkeel.llm import shingles
from evenkeel.llm.arrow import bounded_batches, slices, text_array, trimmed
from evenkeel.llm.components import components
from evenkeel.sources.scratch import materialise

K, PERCENT = 4, 85
CELLS, CHUNKS = 1 << 21, 64
PARTS = 8
#: A side of a join is broadcast up to so many rows (some tens of MB), counted before; beyond it Spark shuffles.
BROADCAST_ROWS = 500_000
#: Pairs of one hub that a task works on.
PAIRS_A_TASK = 2000
#: Rows of a group that stay together; hubs of a group in the second round, and how many times as many in each further one.
TOGETHER, FIRST_HUBS, MORE = 4096, 16, 64


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def survey(docs: DataFrame, k: int) -> DataFrame:
    """Per document doc_id, mark, n and digest of its set; per task and chunk of cells counts of its n-grams."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "mark", "n", "digest", "chunk", "counts"]
        for batch in batches:
            n, digest = [], []
            for b in slices(batch, most=shingles.SLICE_BYTES):
                for s, second in shingles.wide_sets(text_array(b.column("text")), k):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes() + second.tobytes(), digest_size=32).digest() if len(s) else None)
                    count[(s & np.uint64(CELLS - 1)).astype(np.int64)] += 1
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if count.any():
            parts = [p.tobytes() for p in np.split(count, CHUNKS)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(CHUNKS, pa.int64())] * 3, pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(trimmed(run), "doc_id long, mark long, n long, digest binary, chunk int, counts binary")


def corpus_counts(surveyed: DataFrame) -> np.ndarray:
    """The counts of all tasks summed; they are summed on the executors, of CELLS cells each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint32).astype(np.uint64)
                total[c] = total[c] + x if c in total else x
        for c, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(CELLS, np.uint32)
    each = CELLS // CHUNKS
    parts = surveyed.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(trimmed(run), "chunk int, counts binary")
    for r in parts.collect():  # CHUNKS rows
        out[r.chunk * each : (r.chunk + 1) * each] = np.frombuffer(r.counts, np.uint32)
    return out


class Order:
    """The global order of n-grams, its cuts, and which n-grams may have groups that one task shouldn't hold."""

    def __init__(self, counts: np.ndarray):
        rank = np.argsort(counts, kind="stable")
        self.place = np.empty(CELLS, np.uint32)  # of each cell
        self.place[rank] = np.arange(CELLS, dtype=np.uint32)
        total = np.cumsum(counts[rank].astype(np.uint64))
        # Fragments of about equally many n-grams of the corpus.
        self.cuts = np.searchsorted(total, total[-1] * np.arange(1, PARTS, dtype=np.uint64) // np.uint64(PARTS), side="right").astype(np.uint32)
        # A cell stands out if it has much more than the average; its n-grams are dealt over salts.
        often = max(TOGETHER, 4 * int(total[-1] // CELLS))
        hot = np.flatnonzero(counts > often)
        self.hot, self.dealt = hot, np.append(-(-counts[hot].astype(np.int64) // often), 1).astype(np.int32)

    def cells(self, elements: np.ndarray) -> np.ndarray:
        return (elements & np.uint64(CELLS - 1)).astype(np.int64)

    def salts(self, elements: np.ndarray) -> np.ndarray:
        cells = self.cells(elements)
        at = np.searchsorted(self.hot, cells)
        return np.where(np.append(self.hot, -1)[at] == cells, self.dealt[at], 1).astype(np.int32)

    def first(self, elements: np.ndarray, n: int) -> np.ndarray:
        """The indexes of the first ``n`` of the (sorted) elements, in order."""
        place = self.place[self.cells(elements)]
        if n < len(elements):
            near = np.flatnonzero(place <= np.partition(place, n - 1)[n - 1])
            return near[np.argsort(place[near], kind="stable")][:n]
        return np.argsort(place, kind="stable")

    def parts(self, elements: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.place[self.cells(elements)], side="right")


def least(n: Column, m: Column, percent: int) -> Column:
    """How many elements linked sets of sizes n and m have in common at least."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent)).cast("long")


def leading(docs: DataFrame, order: Broadcast, k: int, percent: int) -> DataFrame:
    """key, salt, salts, doc_id, n, place: the first elements of each set. Rows of a key meet by salt, hot ones over ``salts``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Order = order.value
        for batch in batches:
            for b in slices(batch, most=shingles.SLICE_BYTES):
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                key, of, n, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                for i, s in zip(ids, shingles.sets(text_array(b.column("text")), k)):
                    if len(s):
                        first = o.first(s, len(s) - -(-percent * len(s) // 100) + 1)
                        key.append(s[first])
                        of.append(np.full(len(first), i, np.int64))
                        n.append(np.full(len(first), len(s), np.int32))
                        place.append(np.arange(len(first), dtype=np.int32))
                key, of = np.concatenate(key), np.concatenate(of)
                salts = o.salts(key)
                salt = (shingles.mixed(of.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), salt, salts, of, np.concatenate(n), np.concatenate(place))], ["key", "salt", "salts", "doc_id", "n", "place"])

    return docs.mapInArrow(trimmed(run), "key long, salt int, salts int, doc_id long, n int, place int")


def with_groups(rows: DataFrame, hot: bool, keep: str, **values: Column) -> DataFrame:
    """``rows`` with aggregates over all rows of their key, of which ``keep`` stay: within tasks, but for hot keys, which are aggregated apart."""
    together = Window.partitionBy("key", "salt")
    out = rows.withColumns({name: value.over(together) for name, value in values.items()})
    if not hot:
        return materialise(out.filter(keep))
    out = materialise(out.filter(f"salts > 1 or ({keep})"))
    parts = out.filter("salts > 1").drop(*values)
    whole = parts.groupBy(F.col("key").alias("g_key")).agg(F.max("salts").alias("g_salts"), *(value.alias(name) for name, value in values.items()))
    whole = materialise(whole.filter(keep).withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.col("g_salts") - 1))).drop("g_salts"))
    apart = parts.join(_small(whole, whole.count()), (F.col("key") == F.col("g_key")) & (F.col("salt") == F.col("g_salt")))
    return out.filter("salts = 1").unionByName(apart.select(*out.columns))


def _can_link(n: str, place: str, m: str, other: str, percent: int) -> Column:
    """Whether an element at these places can be the first that linked sets of sizes n and m have in common."""
    common = least(F.col(n), F.col(m), percent)
    return (F.col(place) <= F.col(n) - common) & (F.col(other) <= F.col(m) - common)


def _inner(percent: int) -> Column:
    """Whether a row can be the smaller set's (or one of equal size): each pair that can be linked has such a row."""
    return F.col("place") <= F.col("n") - least(F.col("n"), F.col("n"), percent)


def _pairs(rows: DataFrame, hubs: DataFrame, n_hubs: int, percent: int) -> DataFrame:
    """hub, member of different components: each pair once, either way round; ``hubs``: h_key, hub, h_n, h_place, h_salts, h_component."""
    spread = hubs.withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.col("h_salts") - 1)))
    met = rows.join(_small(spread, n_hubs), (F.col("key") == F.col("h_key")) & (F.col("salt") == F.col("h_salt")))
    return _once(met.filter("h_component <> component"), percent)


def _once(met: DataFrame, percent: int) -> DataFrame:
    met = met.filter((F.col("hub") != F.col("doc_id")) & _can_link("h_n", "h_place", "n", "place", percent))
    once = met.groupBy(F.least("hub", "doc_id").alias("u"), F.greatest("hub", "doc_id").alias("v")).agg(F.min("hub").alias("hub"))
    return once.select("hub", F.when(F.col("hub") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("member"))


def _dealt(docs: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """text, hub, salt, role, id: of each pair the member (role 1), and the hub (role 0) once for each salt of its members."""
    bounded_batches(docs.sparkSession)
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("salts"))
    dealt = pairs.join(salts, "hub").select("hub", F.col("member").alias("id"), F.pmod(F.xxhash64("member"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    hubs = salts.select("hub", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = dealt.unionByName(hubs)
    wanted = _small(wanted, 2 * n_pairs)  # a hub has as many members as salts, at least
    return docs.join(wanted, docs["doc_id"] == wanted["id"]).select("text", "hub", "salt", "role", "id")


def overlaps(docs: DataFrame, pairs: DataFrame, n_pairs: int, order: Broadcast, k: int) -> DataFrame:
    """hub, member, n_hub, n_member, overlap of each pair in ``pairs`` (hub, member)."""
    rows = _dealt(docs, pairs, n_pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=shingles.SLICE_BYTES):
                first, second, n = [], [], []
                for s, t in shingles.wide_sets(text_array(b.column("text")), k):
                    part = order.value.parts(s)
                    by = np.argsort(part, kind="stable")
                    s, t = s[by], t[by]
                    at = np.searchsorted(part[by], np.arange(PARTS + 1)).tolist()
                    first += [s[x:y].tobytes() for x, y in zip(at, at[1:])]
                    second += [t[x:y].tobytes() for x, y in zip(at, at[1:])]
                    n.append(len(s))
                row = np.repeat(np.arange(b.num_rows), PARTS)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(row)) for c in ("hub", "salt", "role", "id")), pa.array(np.tile(np.arange(PARTS, dtype=np.int32), b.num_rows)), pa.array(np.repeat(n, PARTS).astype(np.int64)), pa.array(first, pa.binary()), pa.array(second, pa.binary())],
                    ["hub", "salt", "role", "id", "part", "n", "first", "second"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            out = []
            for hub, part, salt, role, i, n, *raw in zip(*(b.column(c).to_pylist() for c in ("hub", "part", "salt", "role", "id", "n", "first", "second"))):
                own = tuple(np.frombuffer(x, np.uint64) for x in raw)
                if at != (hub, part, salt):
                    at, held = (hub, part, salt), []
                if role == 0:
                    held.append((n, own))
                    continue
                out += [(hub, i, n_hub, n, common(own, other)) for n_hub, other in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["hub", "member", "n_hub", "n_member", "overlap"])

    by = ["hub", "part", "salt"]
    parts = rows.mapInArrow(trimmed(cut), "hub long, salt int, role int, id long, part int, n long, first binary, second binary")
    parts = parts.filter("octet_length(first) > 0").repartition(*by).sortWithinPartitions(*by, "role")
    partial = parts.mapInArrow(trimmed(count), "hub long, member long, n_hub long, n_member long, overlap long")
    return partial.groupBy("hub", "member", "n_hub", "n_member").agg(F.sum("overlap").alias("overlap"))


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many elements both sets have; each is given by two hashes, sorted by the first."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0
    spot = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(((b[0][spot] == a[0]) & (b[1][spot] == a[1])).sum())


def _mark(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col(text_col)).alias("mark")


def _numbered(rows: DataFrame) -> DataFrame | None:
    """doc, t_mark, times, own: a number of its own for each text of ids that several rows have; None without such ids."""
    twice = materialise(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("doc_id").alias("doc")))
    n = twice.count()
    if not n:
        return None
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    number, room = F.monotonically_increasing_id(), 1 << 52
    if high < (1 << 63) - room:
        number = F.lit(high + 1) + number
    elif low >= room - (1 << 63):
        number = F.lit(low - 1) - number
    else:
        raise ValueError("ids take up both ends of the 64-bit range: no numbers are left for ids with several rows")
    each = rows.join(_small(twice, n), rows["doc_id"] == twice["doc"]).groupBy("doc", F.col("mark").alias("t_mark")).agg(F.count(F.lit(1)).alias("times"))
    return materialise(each.withColumn("own", number))


def _links(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, n), links between nodes (u, v), and the numbered nodes."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: ids must be integers")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _mark(text_col))
    surveyed = materialise(survey(given, k))
    counts = corpus_counts(surveyed)
    rows = surveyed.filter("chunk is null").select("doc_id", "mark", "n", "digest")
    every = rows.filter("doc_id is not null").withColumnRenamed("doc_id", "node")
    ids = given.filter("doc_id is not null")
    numbered = _numbered(rows)
    if numbered is not None:
        some = _small(numbered, numbered.count())
        every = every.join(some, (F.col("node") == F.col("doc")) & (F.col("mark") == F.col("t_mark")), "left").withColumn("node", F.coalesce("own", "node"))
        ids = ids.join(some, (F.col("doc_id") == F.col("doc")) & (F.col("mark") == F.col("t_mark")), "left").withColumn("doc_id", F.coalesce("own", "doc_id"))

    # 1. Equal sets: ``copies`` are the nodes that another one stands for.
    equal = every.filter("digest is not null").groupBy("digest").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    equal = materialise(equal.filter("first <> last").select("digest", "first"))
    copies = materialise(every.join(_small(equal, equal.count()), "digest").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct())
    n_copies = copies.count()
    dropped = copies.select("v").distinct()
    chosen = ids.join(_small(dropped, n_copies), ids["doc_id"] == dropped["v"], "left_anti")
    if numbered is not None:  # repeated rows enter once; only their texts are shuffled
        again = F.coalesce(F.col("times"), F.lit(1)) > 1
        chosen = chosen.filter(~again).select("doc_id", "text").unionByName(materialise(chosen.filter(again).select("doc_id", "text").dropDuplicates(["doc_id"])))
    else:
        chosen = chosen.select("doc_id", "text")

    # 2. and 3.
    order = docs.sparkSession.sparkContext.broadcast(Order(counts))  # CELLS numbers
    linked = 100 * F.col("overlap") >= percent * (F.col("n_hub") + F.col("n_member") - F.col("overlap"))

    def judged(pairs: DataFrame, n: int) -> DataFrame:
        found = overlaps(chosen, pairs, n, order, k).filter(linked)
        return materialise(found.select(F.col("hub").alias("u"), F.col("member").alias("v")))

    hot = len(order.value.hot) > 0
    hub = F.min(F.when(_inner(percent), F.struct("place", "doc_id", "n")))
    shared = with_groups(leading(chosen, order, k, percent), hot, "times > 1 and h is not null", h=hub, times=F.count(F.lit(1)))
    shared = shared.select("key", "salt", "salts", "doc_id", "n", "place", "times", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("h_n"), F.col("h.place").alias("h_place"))
    tested = materialise(_once(shared, percent))
    links = [judged(tested, tested.count())]

    # 4.
    deal = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) + 1) / (1 << 20)  # in (0, 1]
    left = shared.filter("times > 2").drop("hub", "h_n", "h_place").withColumn("deal", deal)
    columns, now, fresh = left.columns, FIRST_HUBS, True
    while not left.isEmpty():
        if fresh:
            found = components(_union(links))
        labelled = left.join(found, left["doc_id"] == found["node"], "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
        inside = with_groups(labelled, hot, "low <> high", low=F.min("component"), high=F.max("component")).drop("low", "high")
        # Of a group's rows, those dealt up to a share have been hubs, those up to the next share are now.
        share = lambda n: F.lit(float(n)) / F.col("times").cast("double")
        new = inside.filter(_inner(percent) & (F.col("deal") <= share(now)) & (F.lit(now == FIRST_HUBS) | (F.col("deal") > share(now // MORE))))
        new = materialise(new.select(F.col("key").alias("h_key"), F.col("doc_id").alias("hub"), F.col("n").alias("h_n"), F.col("place").alias("h_place"), F.col("salts").alias("h_salts"), F.col("component").alias("h_component")))
        pairs = _pairs(inside, new, new.count(), percent)
        known = tested.select(F.least("hub", "member").alias("k_u"), F.greatest("hub", "member").alias("k_v"))
        pairs = materialise(pairs.join(known, (F.least("hub", "member") == F.col("k_u")) & (F.greatest("hub", "member") == F.col("k_v")), "left_anti"))
        n_pairs = pairs.count()
        fresh = n_pairs > 0
        if fresh:
            links.append(judged(pairs, n_pairs))
            tested = tested.unionByName(pairs)
        left = inside.filter(F.col("times") > now).select(*columns)  # of the others all rows have been hubs
        now *= MORE
    return rows.select("doc_id", "n"), _union([*links, copies]), numbered


def _documents(frame: DataFrame, numbered: DataFrame | None, *columns: str) -> DataFrame:
    """``frame`` with the ids of the nodes in ``columns``."""
    if numbered is None:
        return frame
    some = numbered.select(F.col("doc").alias("_doc"), F.col("own").alias("_own"))
    some = _small(some, some.count())
    for c in columns:
        frame = frame.join(some, F.col(c) == F.col("_own"), "left").withColumn(c, F.coalesce("_doc", c)).drop("_doc", "_own")
    return frame


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """A row per row of ``docs``: ``id_col``, n_shingles, component_id. Ids are integers."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows, links, numbered = _links(docs, id_col, text_col, k, percent)
    found = components(_documents(links, numbered, "u", "v"))
    out = rows.join(found, rows["doc_id"] == found["node"], "left")
    return out.select(F.col("doc_id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of the group of their text, with all their columns.

    Of an id with several texts each text is judged by itself.
    """
    _, links, numbered = _links(docs, id_col, text_col, k, percent)
    found = components(links)
    if numbered is None:
        gone = materialise(found.filter("node <> component").select(F.col("node").alias("_gone")))
        return docs.join(_small(gone, gone.count()), docs[id_col] == gone["_gone"], "left_anti")
    found = _documents(found.withColumn("id", F.col("node")), numbered, "id")
    owners = found.groupBy("component").agg(F.min("id").alias("owner"))
    gone = materialise(found.join(owners, "component").filter("id <> owner").select(F.col("node").alias("_gone")))
    own = numbered.join(gone, numbered["own"] == gone["_gone"], "left_semi").select(F.col("doc").alias("_doc"), "t_mark")
    own = materialise(own)
    left = docs.join(_small(own, own.count()), (docs[id_col] == own["_doc"]) & (_mark(text_col) == own["t_mark"]), "left_anti")
    return left.join(_small(gone, gone.count()), left[id_col] == gone["_gone"], "left_anti")
