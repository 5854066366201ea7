"""Genetic search for weight vectors: driver-side operators, one Spark job per generation."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtest

#: Bounds of the weights.
BOUNDS = {
    "hot": (0.0, 1.0), "cold": (0.0, 0.5), "neighbor": (0.0, 1.0), "carryover": (0.0, 1.0), "reverse": (0.0, 0.5), "hmm_hot": (0.0, 1.0),
    "hmm_cold": (0.0, 0.5), "poisson": (0.0, 0.5), "markov": (0.0, 0.5), "temperature": (0.1, 2.0),
}
DEFAULT_KEYS = ("hot", "cold", "neighbor", "carryover", "reverse", "poisson", "markov", "temperature")
SCORED = ("hot", "cold", "neighbor", "carryover", "reverse", "poisson", "markov")


def check_bounds(weights: dict[str, float]) -> None:
    for k, v in weights.items():
        if k in BOUNDS and not BOUNDS[k][0] <= v <= BOUNDS[k][1]:
            raise ValueError(f"{k}={v} outside {BOUNDS[k]}")


@dataclass
class Config:
    population: int = 50
    generations: int = 100
    crossover: float = 0.8
    mutation: float = 0.15
    gene_mutation: float = 0.2
    blend: float = 0.5
    tournament: int = 3
    elite: int = 5
    sigma: tuple[float, float] = (0.1, 0.02)
    seed: int = 42
    keys: tuple[str, ...] = DEFAULT_KEYS
    checkpoint_every: int = 25

    def __post_init__(self) -> None:
        if self.population < 10 or self.generations < 1:
            raise ValueError("a population of 10 and one generation at least")
        if not (0 <= self.crossover <= 1 and 0 <= self.mutation <= 1):
            raise ValueError("rates must be within 0 and 1")
        if self.elite > self.population / 2:
            raise ValueError("at most half of the population is elite")


@dataclass
class Result:
    best: dict[str, float]
    fitness: float
    log: list[dict[str, float]] = field(default_factory=list)


def evaluate(spark: SparkSession, stats: DataFrame, train_end: int, val_end: int, keys: tuple[str, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """A function from a population to its fitness: one job over all individuals."""

    def run(population: np.ndarray) -> np.ndarray:
        rows = [(i, *[float(dict(zip(keys, v, strict=True)).get(k, 0.0)) for k in SCORED]) for i, v in enumerate(population)]
        weights = spark.createDataFrame(rows, "individual int, " + ", ".join(f"w_{k} double" for k in SCORED))
        got = {r.individual: r.combined for r in backtest.fitness(stats, weights, train_end, val_end).select("individual", "combined").collect()}
        return np.array([got.get(i) or 0.0 for i in range(len(population))])

    return run


def search(evaluate_all: Callable[[np.ndarray], np.ndarray], config: Config, checkpoint: str | None = None) -> Result:
    """Elites, tournaments, blend crossover and shrinking Gaussian mutation; resumes from ``checkpoint`` if it fits."""
    rng = np.random.default_rng(config.seed)
    low, high = (np.array([BOUNDS[k][i] for k in config.keys]) for i in (0, 1))
    population, begin, log = rng.uniform(low, high, (config.population, len(low))), 0, []
    if checkpoint and os.path.exists(checkpoint):
        with open(checkpoint) as f:
            held = json.load(f)
        if tuple(held["keys"]) != config.keys:
            raise ValueError("the checkpoint is of other weights")
        population, begin, log = np.array(held["population"]), held["generation"], held["log"]
        rng.bit_generator.state = held["rng"]
    value = evaluate_all(population)
    best, best_value = population[value.argmax()].copy(), float(value.max())
    for generation in range(begin, config.generations):
        order = np.argsort(-value, kind="stable")
        elite = population[order[: config.elite]]
        picks = rng.integers(0, len(population), (len(population) - len(elite), config.tournament))
        children = population[picks[np.arange(len(picks)), value[picks].argmax(1)]].copy()
        for i in range(0, len(children) - 1, 2):
            if rng.random() < config.crossover:
                gamma = (1 + 2 * config.blend) * rng.random(len(low)) - config.blend
                a, b = children[i].copy(), children[i + 1].copy()
                children[i], children[i + 1] = (1 - gamma) * a + gamma * b, gamma * a + (1 - gamma) * b
        share = generation / max(config.generations - 1, 1)
        sigma = config.sigma[0] + (config.sigma[1] - config.sigma[0]) * share
        changed = (rng.random((len(children), 1)) < config.mutation) & (rng.random(children.shape) < config.gene_mutation)
        children = np.clip(children + changed * rng.normal(0, sigma, children.shape), low, high)
        population = np.vstack((elite, children))
        value = np.concatenate((value[order[: config.elite]], evaluate_all(children)))
        if value.max() > best_value:
            best, best_value = population[value.argmax()].copy(), float(value.max())
        log.append({"generation": generation, "best": float(value.max()), "avg": float(value.mean()), "min": float(value.min()), "std": float(value.std())})
        if checkpoint and ((generation + 1) % config.checkpoint_every == 0 or generation + 1 == config.generations):
            with open(checkpoint, "w") as f:
                json.dump({"keys": config.keys, "generation": generation + 1, "population": population.tolist(), "log": log, "rng": rng.bit_generator.state}, f)
    return Result({k: float(v) for k, v in zip(config.keys, best, strict=True)}, best_value, log)


def save(result: Result, path: str) -> None:
    baseline = {"hit_15": 15 * 6 / 45, "hit_20": 20 * 6 / 45, "mean_rank": 22.5}
    with open(path, "w") as f:
        json.dump({"weights": result.best, "fitness": result.fitness, "random_baseline": baseline}, f, indent=2)


def read_weights(path: str, default: dict[str, float]) -> dict[str, float]:
    """``weights`` of a result file; the default where it is missing or broken."""
    try:
        with open(path) as f:
            return {**default, **json.load(f)["weights"]}
    except (OSError, ValueError, KeyError, TypeError):
        return dict(default)


def as_document(config: Config) -> dict:
    return asdict(config)


def weight_table(spark: SparkSession, vectors: list[dict[str, float]]) -> DataFrame:
    """A population as a table; a weight that a vector lacks is zero."""
    for v in vectors:
        check_bounds(v)
    rows = [(i, *[float(v.get(k, 0.0)) for k in SCORED]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "individual int, " + ", ".join(f"w_{k} double" for k in SCORED)).select("*", F.lit(1).alias("one")).drop("one")
