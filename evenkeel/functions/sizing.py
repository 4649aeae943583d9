"""Sizes that are fixed by public parameters: capacities, quotas, slack. Plain Python, on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

#: Security of the coordination between shards in bits, shards' frontends, largest tree height.
COORDINATION_BITS, FRONTENDS, ROUTING_BITS = 80, 4, 31


def ln_gamma(x: float) -> float:
    return math.lgamma(x)


def binom_pmf(n: int, k: int, p: float) -> float:
    if not 0 <= k <= n:
        return 0.0
    if p <= 0:
        return float(k == 0)
    if p >= 1:
        return float(k == n)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def _tail(n: int, k: int, p: float, up: bool) -> float:
    """The sum of the probabilities from k on in one direction, terms too small to count left out."""
    odds = p / (1 - p)
    terms, term = [], binom_pmf(n, k, p)
    while term > 0:
        terms.append(term)
        if (k >= n if up else k <= 0):
            break
        term *= (n - k) / (k + 1) * odds if up else k / (n - k + 1) / odds
        k += 1 if up else -1
        if term < terms[0] * 1e-18 and (k > n * p if up else k < n * p):
            break
    return min(1.0, math.fsum(terms))


def binom_sf(n: int, k: int, p: float) -> float:
    """P(X >= k), summed from the tail so that small values are exact."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    return 1.0 if p >= 1 else _tail(n, k, p, True)


def binom_lower_tail(n: int, k: int, p: float) -> float:
    """P(X <= k), summed from the tail."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    return _tail(n, k, p, False)


def binom_cdf(n: int, k: int, p: float) -> float:
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return binom_lower_tail(n, k, p) if k < n * p else 1.0 - binom_sf(n, k + 1, p)


def binom_ppf(n: int, p: float, alpha: float) -> int:
    """One less than the smallest k with P(X <= k) >= alpha, at least 0."""
    if p >= 1:
        return n
    if p <= 0:
        return 0
    return max(0, _least(0, n, lambda k: binom_cdf(n, k, p) >= alpha) - 1)


def _least(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """The smallest number from ``low`` on for which a monotone condition holds (``high`` if none before)."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def shard_quota(batch: int, shards: int, bits: int) -> int:
    """The least quota that a shard's share of ``batch`` random keys exceeds with probability 2^-bits over all shards."""
    p = 1 / shards
    return _least(batch // shards, batch, lambda q: binom_sf(batch, q, p) <= 2.0**-bits * p)


def suggested_per_shard_quota(batch: int, shards: int, bits: int, frontends: int = FRONTENDS) -> int:
    """The quota per shard of a batch that ``frontends`` route in equal parts."""
    f = max(1, frontends)
    return f * shard_quota(batch // f, shards, bits + (f - 1).bit_length())


def shard_coordination_slack(per_shard: int, shards: int, bits: int = COORDINATION_BITS) -> int:
    """By how much some shard may be ahead of another one, but with probability 2^-bits."""
    if shards <= 1:
        return 0
    p, n = 1 / shards, per_shard * shards
    most = 2.0**-bits * p / 2
    above = _least(per_shard, n, lambda k: binom_sf(n, k, p) <= most) - per_shard
    below = _least(0, per_shard, lambda d: binom_lower_tail(n, per_shard - d, p) <= most)
    return above + below


def z_scale(z: int) -> int:
    return max(1, z // 4)


def effective_t_capacity(t: int, z: int) -> int:
    return t * z_scale(z)


def deflated_per_shard_resize_target(total: int, shards: int, z: int) -> int:
    each = total * z_scale(z) // shards
    return max(1, max(0, each - shard_coordination_slack(each, shards)) // z_scale(z))


def dp_initial_k(t: int, leaves: int, interval: int) -> int:
    k = math.floor(round((t * leaves / max(1, interval) ** 2) ** (1 / 3), 9))
    return max(1, min(k, leaves))


def dp_det_threshold(t: float, leaves: float, k: float, alpha: float, interval: float, attempts: float) -> float:
    """The threshold without noise, in rows: expected count less what is in flight and the sampling margin."""
    margin = t - leaves / k * binom_ppf(int(t), k / leaves, alpha)
    return t - (1 + attempts) * interval * k - margin


def tree_height(capacity: int, z: int) -> int:
    if z < 1 or z & (z - 1):
        raise ValueError("bucket width must be a power of two")
    return max(1, capacity.bit_length() - 1 - (z.bit_length() - 1))


def leaf_count(height: int) -> int:
    return 1 << height


def tree_capacity(height: int, z: int) -> int:
    return (1 << height) * z


def readout_len(height: int, z: int, stash: int) -> int:
    return (2 << height) * z + stash


def subtree_sizes(height: int, local_height: int, z: int, stash: int, bits: int) -> tuple[int, int, int]:
    """Number of subtrees, inbox length of each, length of each chunk."""
    count = 1 << (height - local_height)
    quota = max(1, shard_quota(count * z + stash, count, bits))
    inbox = 1 << (quota - 1).bit_length()
    return count, inbox, (2 << local_height) * z + inbox
