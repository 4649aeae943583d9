"""Suffix order by induced sorting, in bulk array operations, with common-prefix tests.

As in external induced sorting, suffixes are taken from queues in order, and each hands its
predecessor on to the queue of that one's first character: the suffixes at the start of a rising run
(LMS) induce the falling (L) ones left to right, these induce the rising (S) ones right to left. A
queue holds the suffixes with one first character and is read a generation at a time, so each step
works on whole arrays. A first run orders the LMS substrings, which are then named; the recursion on
the names is carried out by doubling, until the names reach ``depth`` characters or tell all suffixes
apart; a last run induces the order of all. Suffixes that agree to ``depth`` characters stand
together, in any order.
"""

from __future__ import annotations

import numpy as np


def falling(text: np.ndarray) -> np.ndarray:
    """Of each position: whether its suffix is larger than the next one's (the empty one is the smallest)."""
    larger = np.append(text[:-1] > text[1:], True)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)  # of runs of one character
    return np.repeat(larger[ends], np.diff(ends, prepend=-1))


def equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the substrings of ``text`` (16-bit characters) from a and from b on, of ``size`` characters, are the same."""
    four = np.ndarray((len(text) + 1,), "<u8", np.append(text, np.zeros(4, np.uint16)).astype("<u2"), 0, (2,))  # the four characters from each place on
    masks = np.array([(1 << 16 * n) - 1 for n in range(5)], np.uint64)
    same, at, done = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(at):
        rest = size[at] - done
        differ = (four[a[at] + done] ^ four[b[at] + done]) & masks[np.minimum(rest, 4)] != 0
        same[at[differ]] = False
        at = at[~differ & (rest > 4)]
        done += 4
    return same


def induced(text: np.ndarray, fall: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, in the order that the LMS suffixes (in order within their first characters) induce."""
    size = int(text.max()) + 1
    first = text[lms]
    seeds = np.split(lms[np.argsort(first, kind="stable")], np.cumsum(np.bincount(first, minlength=size))[:-1])
    low: list[list[np.ndarray]] = [[] for _ in range(size)]
    high: list[list[np.ndarray]] = [[] for _ in range(size)]

    def hand_on(found: np.ndarray, queues: list[list[np.ndarray]], kind: bool) -> None:
        before = found[found > 0] - 1
        before = before[fall[before] == kind]
        if len(before):
            c = text[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            cut = np.flatnonzero(c[1:] != c[:-1]) + 1
            for part, ch in zip(np.split(before, cut), c[np.append(0, cut)].tolist()):
                queues[ch].append(part)

    low[int(text[-1])].append(np.array([len(text) - 1]))
    for c in range(size):
        at = 0
        while at < len(low[c]):
            hand_on(low[c][at], low, True)
            at += 1
        if len(seeds[c]):
            hand_on(seeds[c], low, True)
    fallen = [np.concatenate(q) if q else np.zeros(0, np.int64) for q in low]
    for c in range(size - 1, -1, -1):
        at = 0
        while at < len(high[c]):
            hand_on(high[c][at], high, False)
            at += 1
        if len(fallen[c]):
            hand_on(fallen[c][::-1], high, False)
    return np.concatenate([x for c in range(size) for x in (fallen[c], np.concatenate(high[c])[::-1] if high[c] else fallen[c][:0])])


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``text`` (small non-negative integers) in the order of their suffixes, to ``depth``."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    text = text.astype(np.uint16)
    fall = falling(text)
    lms = np.flatnonzero(np.append(False, fall[:-1] & ~fall[1:]))
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        rough = induced(text, fall, lms)
        rough = rough[is_lms[rough]]
        rank = np.searchsorted(lms, rough)
        end = np.append(lms[1:] + 1, n)
        begin, size = lms[rank], (end - lms)[rank]
        same = size[1:] == size[:-1]
        same &= equal(text, begin[1:], begin[:-1], np.where(same, size[1:], 0))
        name = np.empty(len(lms), np.int64)
        name[rank] = np.append(0, np.cumsum(~same))
        # Recursion: the string of names, each at least two characters long, is ordered by doubling.
        step, reach = 1, 2
        while name.max() + 1 < len(lms) and reach < depth:
            key = (name.astype(np.uint64) << np.uint64(32)) | np.append(name[step:] + 1, np.zeros(min(step, len(name)), np.int64)).astype(np.uint64)
            order = np.argsort(key)
            ranked = key[order]
            name[order] = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
            step, reach = 2 * step, 2 * reach
        lms = lms[np.argsort(name)]
    return induced(text, fall, lms)


def agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the common prefix of the suffixes a and b has ``depth`` characters or more; both must have as many."""
    return equal(text, a, b, np.full(len(a), depth))
