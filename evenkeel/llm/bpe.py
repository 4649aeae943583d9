"""Byte-level BPE: encoding and decoding by a table of ranks.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole.
The others are merged over a linked list of their bytes, a heap giving the next pair: lowest rank
first, leftmost on ties. A bounded memo of recent pre-tokens stands before both; it only saves time.

Null texts count as empty; empty texts have no ids. Ids are unsigned 32-bit integers. Every row has its
result, repeated ones too; an empty table gives none, further columns are ignored whatever their names.
Texts are encoded whole: a very long one takes memory for all its pre-tokens, some tens of times its
bytes. A table that lacks one of the 256 single bytes is refused (``ValueError``).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from evenkeel.llm.arrow import bounded_batches, slices, trimmed

#: Pre-tokens in each of the two generations that a worker remembers, and the longest of them in characters.
MEMO_ENTRIES, MEMO_LENGTH = 150_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """The token table of a tiktoken file; read on the driver only."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of fixed keys: n slots for n keys, one displacement a bucket."""

    PER_BUCKET = 3

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // self.PER_BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots: list[int] = [-1] * self.n  # slot -> index of its key
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            members.setdefault(h % self.buckets, []).append(i)
        for b, own in sorted(members.items(), key=lambda m: -len(m[1])):
            d = 0
            while True:
                spots = {self._slot(hashes[i], d) for i in own}
                if len(spots) == len(own) and all(self.slots[s] < 0 for s in spots):
                    break
                d += 1
            self.shift[b] = d
            for i in own:
                self.slots[self._slot(hashes[i], d)] = i
        self.shift = self.shift.tolist()

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def index(self, key: bytes) -> int:
        """The index that ``key`` has if it is one of the keys; else that of some other key."""
        h = xxhash.xxh3_64_intdigest(key)
        return self.slots[self._slot(h, self.shift[h % self.buckets])]


class Codec:
    """Encodes and decodes; small enough to be broadcast (its size is that of the vocabulary)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the table lacks {len(missing)} of the 256 single bytes: it can't encode all texts")
        self.pattern = pattern
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.whole = PerfectHash(self.tokens)
        self._ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("pattern", "tokens", "ids", "whole")} | {"_ready": False}

    def _prepare(self) -> None:
        if self._ready:
            return
        self.split = regex.compile(self.pattern).findall
        self.by_id = [b""] * (max(self.ids) + 1)
        for t, i in zip(self.tokens, self.ids):
            self.by_id[i] = t
        # next_to[left id][right id]: the pair's rank, which is also the id of what it becomes.
        known = dict(zip(self.tokens, self.ids))
        self.byte_id = [known.get(bytes([b]), -1) for b in range(256)]
        none: dict[int, int] = {}
        self.next_to = [none] * len(self.by_id)
        for t, i in known.items():
            for cut in range(1, len(t)):
                a, b = known.get(t[:cut]), known.get(t[cut:])
                if a is not None and b is not None:
                    if self.next_to[a] is none:
                        self.next_to[a] = {}
                    self.next_to[a][b] = i
        self.memo = _Memo(self)
        self._ready = True

    def whole_id(self, piece: bytes) -> int:
        """The id of a pre-token that is a token; -1 if it is none."""
        k = self.whole.index(piece)
        return self.ids[k] if self.tokens[k] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token, by merging its bytes."""
        byte_id, next_to = self.byte_id, self.next_to
        ids = [byte_id[b] for b in piece]
        n = len(ids)
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | k for k in range(n - 1) if (r := next_to[ids[k]].get(ids[k + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            rank, k = x >> bits, x & low
            left = ids[k]
            j = after[k]
            if left < 0 or j >= n or next_to[left].get(ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j] = rank, -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if (r := next_to[rank].get(ids[j])) is not None:
                    heappush(heap, r << bits | k)
            j = before[k]
            if j >= 0 and (r := next_to[ids[j]].get(rank)) is not None:
                heappush(heap, r << bits | j)
        return [i for i in ids if i >= 0]

    def piece_bytes(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        i = self.whole_id(raw)
        if i >= 0:
            return i.to_bytes(4, "little")
        ids = self.merge(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        self._prepare()
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.older = dict(memo)
            memo.clear()
        return b"".join(map(memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        self._prepare()
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_built: dict[tuple, Codec] = {}


def codec_of(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of a table; building its perfect hash takes a second, so the last one is kept on the driver."""
    key = (hash(tuple(ranks.items())), pattern)
    if key not in _built:
        _built.clear()
        _built[key] = Codec(ranks, pattern)
    return _built[key]


class _Memo(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece) or self.codec.piece_bytes(piece)
        if len(piece) <= MEMO_LENGTH:
            self[piece] = got
        return got


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    from pyspark.sql import functions as F

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        wide = b.column("text").cast(pa.large_binary())
        yield from slices(pa.RecordBatch.from_arrays([b.column("id"), wide], ["id", "text"]), raw=True)


def _strings(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in column.to_pylist()]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids (array of long) of each row; no shuffle."""
    codec = docs.sparkSession.sparkContext.broadcast(codec_of(ranks, pattern))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        for b in _slices(batches):
            ids = [np.frombuffer(c.encode(t), "<u4").astype(np.int64) for t in _strings(b.column("text"))]
            lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.concatenate([*ids, np.zeros(0, np.int64)])).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in ids], pa.int64()), lists], ["id", "n_tokens", "ids"])

    return _columns(docs, id_col, text_col).mapInArrow(trimmed(run), f"id {kind}, n_tokens long, ids array<long>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, bytes (binary) of each row; ids that the table lacks decode to nothing, null to null."""
    from pyspark.sql import functions as F

    by_id = rows.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    kind = rows.schema[id_col].dataType.simpleString()
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = by_id.value.get
        for b in batches:
            out = [None if x is None else b"".join(get(i, b"") for i in x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    chosen = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(trimmed(run), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids: ``id_col``, n_tokens, ids_sha256, decoded_sha256."""
    codec = docs.sparkSession.sparkContext.broadcast(codec_of(ranks, pattern))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        for b in _slices(batches):
            n, a, d = [], [], []
            for t in _strings(b.column("text")):
                ids = c.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _columns(docs, id_col, text_col).mapInArrow(trimmed(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens of each row."""
    codec = docs.sparkSession.sparkContext.broadcast(codec_of(ranks, pattern))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(c.encode(t)) // 4 for t in _strings(b.column("text"))], pa.int64())], ["id", "n_tokens"])

    return _columns(docs, id_col, text_col).mapInArrow(trimmed(run), f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
