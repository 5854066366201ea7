"""Sequential search of parameters by Parzen estimators: where good trials are dense and others are not."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Trials drawn at random first, points tried against the estimators, and the share of trials that counts as good (at most ``MOST_GOOD``).
FIRST, CANDIDATES, GOOD, MOST_GOOD = 10, 24, 0.1, 25


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    whole: bool = False
    log: bool = False

    def inside(self, v: float) -> float:
        """A value in the inner scale; whole numbers are the middles of intervals of length one."""
        return math.log(v) if self.log else float(v)

    @property
    def ends(self) -> tuple[float, float]:
        return (self.low - 0.5, self.high + 0.5) if self.whole else (self.inside(self.low), self.inside(self.high))

    def value(self, x: float) -> float:
        if self.whole:
            return int(min(max(round(x), self.low), self.high))
        return float(min(max(math.exp(x) if self.log else x, self.low), self.high))


class Density:
    """Normal bumps at the points seen, as wide as the gaps beside them, and one over the whole range."""

    def __init__(self, points: np.ndarray, ends: tuple[float, float]):
        low, high = ends
        order = np.sort(points)
        padded = np.concatenate(([low], order, [high]))
        width = np.maximum(padded[1:-1] - padded[:-2], padded[2:] - padded[1:-1])
        least = (high - low) / min(100, len(points) + 2)
        self.center = np.append(order, (low + high) / 2)
        self.width = np.append(np.clip(width, least, high - low), high - low)
        self.ends = ends

    def drawn(self, r: np.random.Generator, n: int) -> np.ndarray:
        k = r.integers(0, len(self.center), n)
        x = r.normal(self.center[k], self.width[k])
        while (out := (x < self.ends[0]) | (x > self.ends[1])).any():
            x[out] = r.normal(self.center[k[out]], self.width[k[out]])
        return x

    def log_at(self, x: np.ndarray) -> np.ndarray:
        erf = np.vectorize(math.erf)
        z = (x[:, None] - self.center) / self.width
        kept = 0.5 * (erf((self.ends[1] - self.center) / self.width / math.sqrt(2)) - erf((self.ends[0] - self.center) / self.width / math.sqrt(2)))
        each = -0.5 * z**2 - np.log(self.width * math.sqrt(2 * math.pi) * kept * len(self.center))
        top = each.max(1)
        return top + np.log(np.exp(each - top[:, None]).sum(1))


@dataclass
class Search:
    """Asked for the next trial, told what it cost."""

    space: dict[str, Range]
    seed: int = 42
    tried: list[tuple[dict[str, float], float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.random = np.random.default_rng(self.seed)

    def ask(self) -> dict[str, float]:
        if len(self.tried) < FIRST:
            return {k: r.value(self.random.uniform(*r.ends)) for k, r in self.space.items()}
        ranked = sorted(self.tried, key=lambda t: (math.isnan(t[1]), t[1]))
        n_good = min(math.ceil(GOOD * len(ranked)), MOST_GOOD)
        out = {}
        for k, r in self.space.items():
            x = np.array([r.inside(t[0][k]) for t in ranked])
            good, rest = Density(x[:n_good], r.ends), Density(x[n_good:], r.ends)
            points = good.drawn(self.random, CANDIDATES)
            out[k] = r.value(float(points[int((good.log_at(points) - rest.log_at(points)).argmax())]))
        return out

    def tell(self, trial: dict[str, float], cost: float) -> None:
        self.tried.append((trial, cost))

    @property
    def best(self) -> tuple[dict[str, float], float]:
        return min(self.tried, key=lambda t: (math.isnan(t[1]), t[1]))


def minimised(cost: Callable[[dict[str, float]], float], space: dict[str, Range], trials: int = 50, seed: int = 42) -> Search:
    """The least cost found in so many trials, one after the other."""
    search = Search(space, seed)
    for _ in range(trials):
        trial = search.ask()
        search.tell(trial, cost(trial))
    return search
