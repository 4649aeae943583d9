"""Hashed word shingles of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text's set has the 64-bit hashes of its
distinct shingles of ``k`` words; a text of fewer words has its whole sequence as the one shingle, a
text without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from evenkeel.llm.arrow import buffers

#: Texts of a slice; the arrays that stand for a slice take some hundred times that.
SLICE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
#: Start of each of the two hashes of a word; the longest word in bytes that is hashed with the others.
LANES, LONG_WORD = (0x243F6A8885A308D3, 0x13198A2E03707344), 1024
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@lru_cache(maxsize=1)
def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return low, space


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, start and end of all words in order, and the n + 1 offsets of the texts' first words."""
    data, at = buffers(texts)
    low, space = _byte_table()
    inside = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    start = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(data)]))
    end = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]])[: len(data)])) + 1
    return low[data], start, end, np.searchsorted(start, at)


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of the words: their bytes go in by eight, each time mixed; words of eight bytes or less never collide."""
    length = end - start
    hashes = mixed(length.astype(np.uint64) + np.uint64(LANES[lane]))
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    at = np.flatnonzero(length <= LONG_WORD)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), LANES[lane])
    done = 0
    while len(at):
        rest = np.minimum(length[at] - done, 8)
        chunk = eight[start[at] + done] & _MASKS[rest]
        hashes[at] = mixed(hashes[at] ^ (chunk * np.uint64(BASE)))
        done += 8
        at = at[length[at] > done]
    return hashes


def word_hashes(texts: pa.Array, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the n + 1 offsets of the texts' first words."""
    data, start, end, at = word_bounds(texts)
    return _hashed(data, start, end, lane), at


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(BASE) + words[i : i + n])
    return h


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    every = sequences(words, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield sequences(words[a:b], b - a)
        else:
            yield every[:0]


def wide_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``sets``, with a second hash of each shingle: 128 bits, for what must not go wrong by a collision."""
    data, start, end, at = word_bounds(texts)
    lanes = [_hashed(data, start, end, lane) for lane in (0, 1)]
    every = [sequences(words, k) for words in lanes]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        first, second = (h[a : b - k + 1] for h in every) if b - a >= k else (sequences(w[a:b], b - a) if b > a else every[0][:0] for w in lanes)
        order = np.argsort(first)
        first, second = first[order], second[order]
        fresh = np.append(True, first[1:] != first[:-1])[: len(first)]
        if (again := ~fresh).any() and (second[again] != second[np.flatnonzero(again) - 1]).any():  # different shingles of one first hash
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        yield first[fresh], second[fresh]
