"""Character n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from evenkeel.llm.arrow import buffers, text_array


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case (white space: a space; itself where it has no single one); whether it is a letter."""
    low, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for i in range(0x20000):
        c = chr(i)
        letter[i] = c.isalpha()
        if c.isspace():
            low[i] = 32
        elif len(x := c.lower()) == 1:
            low[i] = ord(x)
    letter[0x20000:0x32000] = True  # further ideographs
    return low, letter


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each text between spaces, and the n + 1 offsets."""
    data, at = buffers(texts)
    starts = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(starts)])[at]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(at) - 1
    if len(points) != count[-1]:  # bytes that aren't UTF-8: each such text by itself
        raw = data.tobytes()
        return code_points(text_array(pa.array([raw[a:z].decode("utf-8", "replace") for a, z in zip(at[:-1], at[1:])])))
    low = _tables()[0]
    out = np.full(len(points) + 2 * n, 32, np.uint32)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(count))
    out[np.arange(len(points)) + shift] = low[points]
    return out, count + 2 * np.arange(n + 1)


def has_letter(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.concatenate([[0], np.cumsum(_tables()[1][points])])[at]
    return np.diff(n) > 0


def hashes(points: np.ndarray, sizes: range, bits: int):
    """For each size n: n, and of each position the bucket of the n-gram that starts there."""
    h = np.zeros(len(points), np.uint32)
    for n in range(1, sizes.stop):
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in sizes:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            x ^= x >> np.uint32(12)
            yield n, (x * np.uint32(0x297A2D39)) >> np.uint32(32 - bits)


def per_text(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (of the n-grams by start) over each text's own n-grams."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    last = len(total) - 1
    end = np.minimum(np.maximum(at[1:] - n + 1, at[:-1]), last)
    return total[end] - total[np.minimum(at[:-1], last)]
