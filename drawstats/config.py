"""Engine configuration from JSON or YAML files."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that cannot be used."""


#: Least and most of each number (None: open), and whether the bound itself is allowed.
_RANGES = {
    "recent_n": (1, None), "hot_threshold": (1, None), "hot_window": (1, None), "hot_weight": (0, None), "cold_window": (1, None), "cold_weight": (0, None), "neighbor_weight": (0, None),
    "carryover_weight": (0, None), "reverse_weight": (0, None), "poisson_window": (1, None), "poisson_lambda": (0, 0.5), "markov_lambda": (0, 0.5), "sample_size": (1, None),
    "min_prob_floor": (0, 1), "output_count": (1, None), "max_overlap": (0, 6), "prior_alpha": (0, None), "prior_beta": (0, None),
}
_OPEN = {("prior_alpha", "low"), ("prior_beta", "low"), ("min_prob_floor", "high")}


@dataclass(frozen=True)
class EngineConfig:
    recent_n: int = 50
    prior_alpha: float = 1.0
    prior_beta: float = 1.0
    hot_threshold: int = 2
    hot_window: int = 5
    hot_weight: float = 0.4
    cold_window: int = 10
    cold_weight: float = 0.15
    neighbor_weight: float = 0.3
    carryover_weight: float = 0.2
    reverse_weight: float = 0.1
    poisson_window: int = 20
    poisson_lambda: float = 0.5
    markov_lambda: float = 0.3
    sample_size: int = 50000
    min_prob_floor: float = 0.001
    output_count: int = 5
    max_overlap: int = 3
    seed: int = 42

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            whole = f.type == "int"
            if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
                raise ConfigError(f"{f.name} is no {f.type}")
            low, high = _RANGES.get(f.name, (None, None))
            if low is not None and (value < low or (value == low and (f.name, "low") in _OPEN)):
                raise ConfigError(f"{f.name} is too small")
            if high is not None and (value > high or (value == high and (f.name, "high") in _OPEN)):
                raise ConfigError(f"{f.name} is too large")

    @classmethod
    def of(cls, values: object) -> EngineConfig:
        if not isinstance(values, dict):
            raise ConfigError("the root must be an object")
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ConfigError(f"unknown keys: {sorted(unknown)}")
        return cls(**values)


def load(path: str) -> EngineConfig:
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    text = p.read_text(encoding="utf-8")
    if p.suffix == ".json":
        try:
            return EngineConfig.of(json.loads(text))
        except json.JSONDecodeError as e:
            raise ConfigError(str(e)) from e
    if p.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("YAML files need the yaml package") from e
        return EngineConfig.of(yaml.safe_load(text) or {})
    raise ConfigError(f"{p.suffix} files are not read")
