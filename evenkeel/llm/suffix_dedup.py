"""Removal of repeated substrings: every byte inside a ``LENGTH``-byte string that also starts earlier.

The order of suffixes comes from induced sorting (``induced_sort``). Only the part of the text whose
strings may repeat is sorted; what is left out by the steps before cannot hold, or is known to hold,
a repeated string:

1. Texts that equal an earlier document's are repeated as a whole.
2. Each ``LENGTH``-byte window picks the smallest hash among its ``GRAM``-byte grams (the leftmost on
   ties); neighbouring windows with one pick form a run. Equal windows pick equal grams, so runs are
   dealt by gram: a gram with one run has nothing repeated, and of runs that are equal as a whole
   all but the first are repeated.
3. The bytes of the remaining runs, dealt and externally sorted by gram, are cut into shards of about
   ``SHARD`` bytes at the borders of grams. In each shard the suffixes are sorted by induction; windows
   whose suffixes agree to ``LENGTH`` bytes are one class, of which the first stays.

Runs are the same if two 64-bit hashes of their bytes are; in shards, bytes are compared. A task remembers
runs that came again, and passes on later ones as known to be repeated, so a passage that all documents
have costs some rows per task. Shards are bounded: the runs of a gram with many different ones are cut into
windows, dealt further by where in the run a window starts and by its bytes; of equal windows each task
passes on the first ones only.

Strings are judged on the input; matches never cross documents. Null texts are empty. Of equal ids the
texts are ordered by their hash; repeated rows (one id, one text) are the same document and get the same
result. Null ids count as largest, all of them as one. Texts are read whole, very long ones in pieces. An
empty table gives no rows; further columns are ignored, whatever their names. Ids must be integers
(``TypeError``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evenkeel.llm import induced_sort
from evenkeel.llm.arrow import bounded_batches, buffers, slices, trimmed
from evenkeel.llm.shingles import BASE, LANES, mixed
from evenkeel.sources.scratch import materialise

LENGTH, GRAM = 100, 36
#: Bytes worked on at once in step 2 (with an overlap), bytes of a shard, and different runs of a gram that stay together.
PIECE, SHARD, TOGETHER = 1 << 20, 2 << 20, 4000
#: Runs, and windows, that a task remembers to tell later ones that equal them.
REMEMBERED = 100_000
#: A side of a join is broadcast up to so many rows (some tens of MB), counted before; beyond it Spark shuffles.
BROADCAST_ROWS = 500_000
LAST = (1 << 63) - 1


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """The hashes of all substrings of ``gram`` bytes (8 or more), each from two shorter ones that cover it."""
    own, size = mixed(_eights(data)[: len(data) - 7]), 8
    while size < gram:
        shift = min(size, gram - size)
        own = mixed(own[:-shift] + own[shift:] * np.uint64(BASE))
        size += shift
    return own


def spans(eights: np.ndarray, start: np.ndarray, length: int, lane: int) -> np.ndarray:
    """One of two hashes of the ``length`` bytes from each ``start`` on."""
    own = np.full(len(start), LANES[lane], np.uint64)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        own = mixed(own ^ (eights[start + at] * np.uint64(BASE)))
    return own


def runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the texts in ``data`` (offsets ``at``): gram hash, two run hashes, text, first window, further windows, place of the gram in the run."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    n = len(data)
    if n < length:
        return none
    hashes = grams(data, gram)
    bits = np.uint64(max(n, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    picked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    wide, reach = length - gram + 1, 1
    while reach < wide:  # the smallest of ``wide`` neighbours
        step = min(reach, wide - reach)
        picked = np.minimum(picked[:-step], picked[step:])
        reach += step
    place = (picked & low).astype(np.int64)
    window = np.arange(len(place))
    text = np.searchsorted(at, window, side="right") - 1
    inside = window + length <= at[text + 1]
    window, place, text = window[inside], place[inside], text[inside]
    if not len(window):
        return none
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    lo, hi, p, of = window[first], window[last], place[first], text[first]
    # A run is all covered by its first and its last window.
    eights, shape = _eights(data), ((hi - lo) << 16 | (p - lo)).astype(np.uint64)
    run = [mixed(spans(eights, lo, length, lane) + np.uint64(BASE) * mixed(spans(eights, hi, length, lane) ^ shape)) for lane in (0, 1)]
    return hashes[p], *run, of, lo - at[of], hi - lo, p - lo


class Seen:
    """Runs that a task has come across more than once, a bounded number, with their first place so far."""

    def __init__(self):
        self.gram, self.run, self.other = (np.zeros(0, np.uint64) for _ in range(3))
        self.doc, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, gram: np.ndarray, run: np.ndarray, other: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of the runs an equal one of this task is earlier than, for certain."""
        order = np.lexsort((start, doc, other, run, gram))
        sure = np.zeros(len(gram), bool)
        sure[order[1:]] = (gram[order[1:]] == gram[order[:-1]]) & (run[order[1:]] == run[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        heads = order[:-1][sure[order[1:]] & ~sure[order[:-1]]]
        if len(self.run):
            at = np.minimum(np.searchsorted(self.run, run), len(self.run) - 1)
            known = ~sure & (self.run[at] == run) & (self.gram[at] == gram) & (self.other[at] == other)
            sure |= known & ((doc > self.doc[at]) | ((doc == self.doc[at]) & (start > self.start[at])))
            heads = np.union1d(heads, np.flatnonzero(known))
        if len(heads):
            every = [np.concatenate([new[heads], old]) for new, old in ((gram, self.gram), (run, self.run), (other, self.other), (doc, self.doc), (start, self.start))]
            every = [x[: 2 * REMEMBERED] for x in every]
            order = np.lexsort((every[4], every[3], every[2], every[0], every[1]))
            every = [x[order] for x in every]
            fresh = np.append(True, (every[1][1:] != every[1][:-1]) | (every[0][1:] != every[0][:-1]) | (every[2][1:] != every[2][:-1]))
            self.gram, self.run, self.other, self.doc, self.start = (x[fresh] for x in every)
        return sure


def repeated(texts: list[bytes], order: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """(text, first window, last window) of the windows in ``texts`` that an earlier one equals; a text's windows start at ``order`` (document, place)."""
    size = np.array([len(t) for t in texts])
    joined = np.zeros(int(size.sum()) + len(texts), np.uint16)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    for t, a in zip(texts, at.tolist()):
        joined[a : a + len(t)] = np.frombuffer(t, np.uint8)
        joined[a : a + len(t)] += 1
    found = induced_sort.suffixes(joined, length)
    text = np.repeat(np.arange(len(texts)), size + 1)[found]
    whole = found + length < at[text + 1]
    found, text = found[whole], text[whole]
    if not len(found):
        return []
    same = induced_sort.agree(joined, found[1:], found[:-1], length)
    group = np.append(0, np.cumsum(~same))
    document = np.array([o[0] for o in order], np.int64)[text]
    place = np.array([o[1] for o in order], np.int64)[text] + found - at[text]
    rank = np.lexsort((place, document, group))
    later = np.append(False, group[rank][1:] == group[rank][:-1])
    gone = np.sort(found[rank][later])
    if not len(gone):
        return []
    cut = np.flatnonzero(np.diff(gone) > 1)
    first, last = gone[np.append(0, cut + 1)], gone[np.append(cut, len(gone) - 1)]
    of = np.searchsorted(at, first, side="right") - 1
    return list(zip(of.tolist(), (first - at[of]).tolist(), (last - at[of]).tolist()))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, spans (array of first, end)."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: ids must be integers")
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(id_col).isNull().alias("no_id"), text.alias("text"))
    given = given.withColumn("digest", F.sha2("text", 256))

    # 1. The first document of each text; the place of a text among those of one id.
    rows = materialise(given.select("doc", "no_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    owners = rows.groupBy("digest").agg(F.min("doc").alias("owner"))
    alone = owners.withColumn("alt", F.row_number().over(Window.partitionBy("owner").orderBy("digest")) - 1)
    # A text too short for a window may stay repeated.
    known = rows.groupBy("doc", "digest").agg(((F.count(F.lit(1)) > 1) & (F.max("n_bytes") >= length)).alias("again")).join(alone, "digest")
    odd = known.filter("doc <> owner or alt > 0 or again").select(F.col("doc").alias("o_doc"), F.col("digest").alias("o_digest"), (F.col("doc") == F.col("owner")).alias("o_first"), F.col("alt").alias("o_alt"), "again")
    odd = materialise(odd)
    texts = given.join(_small(odd, odd.count()), (F.col("doc") == F.col("o_doc")) & (F.col("digest") == F.col("o_digest")), "left")
    texts = texts.filter("coalesce(o_first, true)").select("doc", F.coalesce("o_alt", F.lit(0)).cast("long").alias("alt"), "digest", "text", F.coalesce("again", F.lit(False)).alias("again"))
    if odd.filter("o_first and again").isEmpty():
        texts = texts.drop("again")
    else:  # repeated rows enter once; only their texts are shuffled
        once = materialise(texts.filter("again").drop("again").dropDuplicates(["doc", "digest"]))
        texts = texts.filter("not again").drop("again").unionByName(once)

    # 2. Runs of windows by gram.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for b in slices(batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").cast(pa.large_binary())), most=PIECE, raw=True):
                doc, alt = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "alt"))
                data, at = buffers(b.column("text"))
                for base, piece, bounds, first in pieces(data, at, length):
                    g, run, other, of, lo, more, p = runs(piece, bounds, length, gram)
                    start, owner = (alt[of + first] << 40) + lo + base, doc[of + first]
                    # Runs known to be repeated are dealt by document.
                    sure = seen.later(g, run, other, owner, start)
                    g = np.where(sure, mixed(owner.astype(np.uint64)), g)
                    columns = [g.view(np.int64), sure, run.view(np.int64), other.view(np.int64), owner, start, more.astype(np.int16), p.astype(np.int16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "sure", "run", "other", "doc", "start", "more", "place"])

    made = texts.select("doc", "alt", "text").mapInArrow(trimmed(cut), "gram long, sure boolean, run long, other long, doc long, start long, more short, place short")
    of_gram = Window.partitionBy("gram", "sure")
    of_run = Window.partitionBy("gram", "sure", "run", "other").orderBy("doc", "start")
    ranked = made.withColumns({"_n": F.count(F.lit(1)).over(of_gram), "_low": F.min("run").over(of_gram), "_high": F.max("run").over(of_gram)}).filter("sure or _n > 1")
    ranked = ranked.withColumn("_rank", F.row_number().over(of_run)).filter("sure or _rank > 1 or _low <> _high")
    first = (F.col("_rank") == 1) & ~F.col("sure")
    ranked = materialise(ranked.select(F.when(first, F.col("gram")).alias("gram"), F.when(first, F.col("_n")).alias("n"), F.when(first, F.col("place")).alias("place"), "doc", "start", "more"))
    gone = ranked.filter("gram is null").select("doc", "start", "more")

    # 3. The bytes of the runs that are left, in shards.
    left = ranked.filter("gram is not null")
    asked = left.groupBy("doc", F.shiftright("start", 40).alias("alt")).agg(F.collect_list(F.struct("gram", "n", "place", "start", "more")).alias("asked"))
    asked = asked.select(F.col("doc").alias("a_doc"), F.col("alt").alias("a_alt"), "asked")
    source = texts.join(asked, (F.col("doc") == F.col("a_doc")) & (F.col("alt") == F.col("a_alt"))).select("doc", "text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "part", "doc", "start", "bytes"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        out: list[tuple] = []
        first_seen: dict[tuple, tuple[int, int]] = {}  # window of a gram with very many runs: its first place so far
        for b in batches:
            asked = b.column("asked")
            bounds = asked.offsets.to_pylist()
            for i, (doc, raw) in enumerate(zip(b.column("doc").to_pylist(), b.column("text").to_pylist())):
                for step in range(bounds[i], bounds[i + 1], 10_000):
                    wanted = asked.values.slice(step, min(10_000, bounds[i + 1] - step))
                    for g, n, place, start, more in zip(*(wanted.field(c).to_pylist() for c in ("gram", "n", "place", "start", "more"))):
                        at = start & ((1 << 40) - 1)
                        if n <= TOGETHER:
                            out.append((g, 0, doc, start, raw[at : at + more + length]))
                            continue
                        parts = 1 + n // TOGETHER
                        for k in range(more + 1):
                            window = raw[at + k : at + k + length]
                            here, before = (doc, start + k), first_seen.get((g, place - k, window))
                            if before is not None and before <= here:
                                if before < here:
                                    out.append((g, -1, *here, None))  # repeated, whatever else there is
                                continue
                            if len(first_seen) >= REMEMBERED:
                                first_seen.clear()
                            first_seen[(g, place - k, window)] = here
                            deal = int.from_bytes(hashlib.blake2b(window, digest_size=6).digest(), "little") % parts
                            out.append((g, 1 + (place - k) * parts + deal, *here, window))
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard() -> pa.RecordBatch:
            found = repeated(held, order, length) if held else []
            columns = [[order[t][0] for t, _, _ in found], [order[t][1] + a for t, a, _ in found], [z - a for _, a, z in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start", "more"])

        held: list[bytes] = []
        order: list[tuple] = []
        size, at = 0, None
        for b in batches:
            known = b.filter(pc.less(b.column("part"), 0))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column("doc"), known.column("start"), pa.array(np.zeros(known.num_rows, np.int64))], ["doc", "start", "more"])
                b = b.filter(pc.greater_equal(b.column("part"), 0))
            for g, part, doc, start, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "part", "doc", "start", "bytes"))):
                if (g, part) != at and size >= SHARD:
                    yield shard()
                    held, order, size = [], [], 0
                at = (g, part)
                held.append(raw)
                order.append((doc, start))
                size += len(raw)
        if held:
            yield shard()

    # Windows known to be repeated need no order; they are dealt evenly.
    sent = source.mapInArrow(trimmed(fetch), "gram long, part long, doc long, start long, bytes binary")
    sent = sent.withColumn("gram", F.when(F.col("part") < 0, F.xxhash64("doc", "start")).otherwise(F.col("gram"))).repartition("gram", "part").sortWithinPartitions("gram", "part")
    gone = gone.unionByName(sent.mapInArrow(trimmed(judge), "doc long, start long, more long"))

    # The union of the windows, as spans of bytes.
    gone = gone.select("doc", F.shiftright("start", 40).alias("alt"), F.col("start").bitwiseAND((1 << 40) - 1).alias("first"), (F.col("start").bitwiseAND((1 << 40) - 1) + F.col("more") + length).alias("end"))
    by_text = Window.partitionBy("doc", "alt").orderBy("first", "end")
    before = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("_new", F.when(F.col("first") <= before, 0).otherwise(1)).withColumn("_span", F.sum("_new").over(by_text))
    spans = gone.groupBy("doc", "alt", "_span").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    spans = spans.groupBy("doc", "alt").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans")).select(F.col("doc").alias("s_doc"), F.col("alt").alias("s_alt"), "spans")
    spans = materialise(spans)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = []
            for raw, own in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                h, at = hashlib.sha256(), 0
                for s in own:
                    h.update(raw[at : s["first"]])
                    at = s["end"]
                h.update(raw[at:])
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(sha, pa.string()), b.column("spans")], ["digest", "kept", "spans"])

    touched = texts.join(_small(spans, spans.count()), (F.col("doc") == F.col("s_doc")) & (F.col("alt") == F.col("s_alt"))).select("digest", "text", "spans")
    touched = touched.mapInArrow(trimmed(keep), "digest string, kept string, spans array<struct<first:long,end:long>>").dropDuplicates(["digest"])
    result = rows.join(owners, "digest").join(touched, "digest", "left")
    copy = (F.col("doc") != F.col("owner")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))
    own = F.coalesce("spans", F.array().cast("array<struct<first:long,end:long>>"))
    result = result.withColumn("_spans", F.when(copy, whole).when(F.col("doc") != F.col("owner"), F.array().cast("array<struct<first:long,end:long>>")).otherwise(own))
    kept = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(F.size("_spans") > 0, F.col("kept")).otherwise(F.col("digest"))
    return result.select(
        F.when(~F.col("no_id"), F.col("doc")).cast(kind).alias(id_col),
        "n_bytes",
        F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"]).alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        kept.alias("kept_sha256"),
        F.col("_spans").alias("spans"),
    )


def pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """The texts, very long ones in overlapping pieces: place in the text, bytes, offsets, number of the first text."""
    if len(data) <= 2 * PIECE:
        yield 0, data, at, 0
        return
    for k in range(len(at) - 1):  # a slice over the bound is one long text
        for base in range(0, max(1, int(at[k + 1] - at[k]) - length + 1), PIECE):
            part = data[at[k] + base : min(at[k] + base + PIECE + length - 1, at[k + 1])]
            yield base, part, np.array([0, len(part)]), k
