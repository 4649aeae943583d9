import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.functions import sizing
from evenkeel.operators import shape
from evenkeel.operators.resize import Controller, DiscreteLaplace


def test_goldens():
    assert sizing.suggested_per_shard_quota(4096, 16, 80) == 648
    assert sizing.suggested_per_shard_quota(1024, 4, 80) == 576
    assert sizing.shard_quota(1024, 16, 80) == 160
    assert sizing.suggested_per_shard_quota(1024, 16, 40) == 212
    assert sizing.deflated_per_shard_resize_target(6400, 16, 64) == 297
    assert sizing.deflated_per_shard_resize_target(102_400, 16, 4) == 4764


@pytest.mark.parametrize("capacity,z,stash,height,whole,length", [(16, 4, 64, 2, 16, 96), (128, 4, 64, 5, 128, 320), (256, 4, 64, 6, 256, 576), (1024, 4, 64, 8, 1024, 2112), (512, 16, 32, 5, 512, 1056)])
def test_tree_sizes(capacity, z, stash, height, whole, length):
    h = sizing.tree_height(capacity, z)
    assert (h, sizing.tree_capacity(h, z), sizing.readout_len(h, z, stash)) == (height, whole, length)


def test_subtree_sizes():
    for local, slots in ((1, 2560), (2, 1536), (3, 1024)):
        count, inbox, chunk = sizing.subtree_sizes(6, local, 4, 64, 80)
        assert inbox == 64 and count * chunk == slots


def test_tail_below_epsilon_stays_positive():
    assert 0 < sizing.binom_sf(1024, 150, 1 / 16) < 2**-52


def test_quota_is_minimal():
    p = 1 / 16
    assert sizing.binom_sf(1024, 160, p) <= 2**-80 * p < sizing.binom_sf(1024, 159, p)


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 40), st.integers(-1, 41), st.floats(0.01, 0.99))
def test_tails_against_sums(n, k, p):
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    assert sizing.binom_cdf(n, k, p) == pytest.approx(math.fsum(pmf[: max(0, k + 1)]), abs=1e-9)
    assert sizing.binom_sf(n, k, p) == pytest.approx(math.fsum(pmf[max(0, k) :]), abs=1e-9)
    if 0 <= k <= n:
        assert sizing.binom_pmf(n, k, p) == pytest.approx(pmf[k], rel=1e-9)


def test_edges():
    assert sizing.binom_sf(10, 3, 1.0) == 1 and sizing.binom_sf(10, 0, 0.0) == 1 and sizing.binom_sf(10, 1, 0.0) == 0
    assert sizing.binom_ppf(10, 1.0, 0.05) == 10 and sizing.binom_ppf(10, 0.0, 0.05) == 0
    assert sizing.shard_coordination_slack(100, 1) == 0
    with pytest.raises(ValueError):
        sizing.tree_height(64, 12)


def test_sampler():
    noise = DiscreteLaplace(1.0)
    assert (noise.cutoff, noise.trials, noise.upper_quantile(0.05)) == (238263423799583, 537, 14)
    q = noise.q
    tail = lambda z: q ** (z + 1) / (1 + q)
    assert tail(14) <= 0.05 < tail(13)
    draws = [noise.sample(random.Random(s)) for s in range(300)]
    assert all(abs(d) <= noise.trials for d in draws) and len(set(draws)) > 10
    with pytest.raises(ValueError):
        DiscreteLaplace(0)
    with pytest.raises(ValueError):
        noise.upper_quantile(0.5)


def test_controller_by_seed_and_after_restart():
    one, two = (Controller(200, 4, 20, 6, seed=3) for _ in range(2))
    for seen in (1, 5, 900, 2):
        assert one.decide(seen, 6) == two.decide(seen, 6)
    saved = one.save()
    again = Controller(200, 4, 20, 6, seed=3)
    again.restore(saved)
    assert [one.decide(x, 6) for x in (3, 4, 5)] == [again.decide(x, 6) for x in (3, 4, 5)]


def test_marks():
    assert shape.marks([2, 1], 3) == [0, 1, 2, 2, 3, 3, 3]
