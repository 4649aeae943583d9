"""Growth by a seeded noisy threshold, in the manner of differential privacy.

The statistic is the number of keys of the current epoch on a sample of leaves, taken from the merged
state in one aggregation. Whether a privacy proof for another statistic carries over to this one is
open, so the rule is called DP-style only. Results depend on the seed and the data alone.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import keys, sizing
from evenkeel.operators.aggregate import count_matching

#: Grid of the sampler's probability, its statistical distance, further growth attempts allowed for.
PROBABILITY_BITS, STATISTICAL_BITS, ATTEMPTS = 48, 128, 2


class DiscreteLaplace:
    """Differences of two capped geometric variables; every sample draws the same number of words."""

    def __init__(self, eps: float):
        if not (math.isfinite(eps) and eps > 0):
            raise ValueError(f"eps is {eps}: it has to be a positive number")
        scale = 1 << PROBABILITY_BITS
        self.cutoff = math.floor(math.exp(-eps / 6) * scale) + 2  # rounded up: rather more noise than less
        if self.cutoff >= scale:
            raise ValueError(f"eps is {eps}: the sampler can't represent so little")
        self.q = self.cutoff / scale
        self.trials = math.ceil((STATISTICAL_BITS + 1) * math.log(2) / -math.log(self.q))

    def sample(self, rng: random.Random) -> int:
        draws = [[rng.getrandbits(PROBABILITY_BITS) < self.cutoff for _ in range(self.trials)] for _ in range(2)]
        up, down = (d.index(False) if False in d else self.trials for d in draws)
        return up - down

    def upper_quantile(self, p: float) -> int:
        """The least z >= 0 that a sample exceeds with probability ``p`` at most."""
        if not 0 < p < 0.5:
            raise ValueError("the probability must be in (0, 0.5)")
        z = math.ceil(math.log(p * (1 + self.q)) / math.log(self.q)) - 1
        return min(max(z, 0), self.trials)


@dataclass
class Controller:
    t_capacity: int
    z: int
    interval: int
    height: int
    eps: float = 1.0
    alpha: float = 0.05
    seed: int = 0
    evicted: int = 0
    waiting: int = 0  # updates since the last check
    resizes: int = 0
    samples: int = 0
    trace: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.noise = DiscreteLaplace(self.eps)
        self.rng = random.Random(self.seed)
        self._set(self.height)

    def _draw(self) -> int:
        self.samples += 1
        return self.noise.sample(self.rng)

    def _set(self, height: int) -> None:
        leaves, t = sizing.leaf_count(height), sizing.effective_t_capacity(self.t_capacity, self.z)
        self.k = sizing.dp_initial_k(t, leaves, self.interval)
        fixed = sizing.dp_det_threshold(t, leaves, self.k, self.alpha, self.interval, ATTEMPTS)
        units = math.floor((fixed - t / 2) / (leaves / self.k))
        self.threshold = units + self._draw() - self.noise.upper_quantile(self.alpha) - self.noise.upper_quantile((2 * self.alpha) ** ATTEMPTS)

    @property
    def due(self) -> bool:
        """Whether the updates since the last check stand for ``k`` evictions, one for each ``interval`` of them."""
        return self.waiting >= self.k * self.interval

    def check(self, state: DataFrame, height: int) -> bool:
        """Whether to grow, by the keys on the next ``k`` leaves; ``state`` has tags of the current epoch."""
        leaves = keys.eviction_leaves(height, self.evicted, self.k)
        seen = count_matching(state, keys.leaf(F.col("tag"), height), leaves).first().matching
        return self.decide(seen, height)

    def decide(self, seen: int, height: int) -> bool:
        self.evicted += self.k
        self.waiting = max(0, self.waiting - self.k * self.interval)
        grow = seen + self._draw() > self.threshold
        self.trace.append({"height": height, "k": self.k, "seen": seen, "threshold": self.threshold, "grow": grow})
        return grow

    def on_grown(self, height: int) -> None:
        self.resizes += 1
        self.t_capacity *= 2
        self.height = height
        self._set(height)

    # State that survives a restart: a replay draws the same noise again.

    def save(self) -> dict:
        return {"t_capacity": self.t_capacity, "evicted": self.evicted, "waiting": self.waiting, "height": self.height, "resizes": self.resizes, "samples": self.samples, "threshold": self.threshold, "k": self.k}

    def restore(self, saved: dict) -> None:
        self.rng = random.Random(self.seed)
        for _ in range(saved["samples"]):
            self.noise.sample(self.rng)
        for name, value in saved.items():
            setattr(self, name, value)
