"""Configuration: thresholds, limits and disabled metrics, with defaults."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from typing import Any

BUCKETS = ("excellent", "good", "fair", "poor", "critical")


@dataclass(frozen=True)
class Thresholds:
    """Four boundaries between five buckets."""

    excellent: float
    good: float
    fair: float
    poor: float

    @classmethod
    def parse(cls, found: dict[str, Any], default: Thresholds | None = None) -> Thresholds:
        unknown = set(found) - set(BUCKETS[:4])
        if unknown:
            raise ValueError(f"unknown threshold: {', '.join(sorted(unknown))}")
        if default:
            return replace(default, **{k: float(v) for k, v in found.items()})
        missing = set(BUCKETS[:4]) - set(found)
        if missing:
            raise ValueError(f"missing threshold: {', '.join(sorted(missing))}")
        return cls(**{k: float(v) for k, v in found.items()})


@dataclass(frozen=True)
class TwoSided:
    """Boundaries for values that can be too low as well as too high."""

    low: Thresholds
    high: Thresholds

    @classmethod
    def parse(cls, found: dict[str, Any], default: TwoSided) -> TwoSided:
        """A flat table sets the high side; `low` and `high` set either."""
        if set(found) & {"low", "high"}:
            if set(found) - {"low", "high"}:
                raise ValueError(f"unknown key: {', '.join(sorted(set(found) - {'low', 'high'}))}")
            return cls(*(Thresholds.parse(found[side]) if side in found else getattr(default, side) for side in ("low", "high")))
        return cls(default.low, Thresholds.parse(found))


# Default boundaries of each metric, excellent to poor.
DEFAULTS = {
    "dag_density": (0.5, 1.0, 1.5, 2.0),
    "fan_in_max": (3, 5, 10, 15),
    "fan_in_mean": (0.5, 1, 2, 3),
    "fan_out_max": (3, 5, 8, 12),
    "fan_out_mean": (0.5, 1, 2, 3),
    "params": (3, 5, 7, 10),
    "cyclomatic": (5, 10, 20, 30),
    "cognitive": (5, 10, 15, 25),
    "methods_per_struct": (5, 10, 15, 25),
    "lcom": (2, 3, 4, 5),
    "file_loc": (200, 400, 600, 1000),
    "max_scope": (15, 30, 50, 100),
    "duplication_pct": (3, 5, 10, 20),
    "line_cov": (90, 80, 70, 60),
    "uncov_branches": (1, 3, 6, 10),
}
SIZE_DEFAULT = TwoSided(Thresholds(5, 4, 3, 1), Thresholds(20, 50, 100, 200))

#: The order in which rows are collected, and that in which they are shown; "down": lower is worse.
COLLECTED = ("fan_out", "cyclomatic", "params", "cognitive", "max_scope", "methods_per_struct", "file_loc", "duplication_pct", "lcom", "line_cov", "uncov_branches", "function_size", "fan_in")
SHOWN = ("fan_out", "fan_in", "function_size", "params", "cyclomatic", "cognitive", "max_scope", "methods_per_struct", "file_loc", "duplication_pct", "lcom", "line_cov", "uncov_branches")
LOWER_IS_WORSE = frozenset({"line_cov"})
#: Values that are not worth a row, at this value or better.
BORING = {"cognitive": 1, "max_scope": 0, "methods_per_struct": 0, "file_loc": 0, "duplication_pct": 0, "lcom": 0, "line_cov": 100, "uncov_branches": 0, "fan_out": 0, "cyclomatic": 1, "params": 0, "function_size": 1}
METRICS = ("dag_density", *SHOWN)
#: Metrics that the ignore command accepts.
IGNORABLE = ("fan_in", "fan_out", "function_size", "params", "cyclomatic", "methods_per_struct", "lcom", "file_loc", "max_scope")


@dataclass(frozen=True)
class Config:
    thresholds: dict[str, Thresholds] = field(default_factory=lambda: {k: Thresholds(*map(float, v)) for k, v in DEFAULTS.items()})
    function_size: TwoSided = SIZE_DEFAULT
    display_mode: str = "both"
    hub_min_fan_in: int = 10
    hub_min_fan_out: int = 3
    min_tokens: int = 50
    disabled_metrics: frozenset[str] = frozenset()

    def by_name(self, metric: str) -> Thresholds:
        """Boundaries of a metric; fan_in and fan_out have those of their maximum; function_size has its high side."""
        if metric == "function_size":
            return self.function_size.high
        return self.thresholds.get(f"{metric}_max") or self.thresholds[metric]

    def is_disabled(self, metric: str) -> bool:
        return metric in self.disabled_metrics

    @classmethod
    def parse(cls, found: dict[str, Any] | None) -> Config:
        """From the tables of a configuration file; what is not set has its default."""
        found, base = found or {}, cls()
        given = dict(found.get("thresholds") or {})
        size = TwoSided.parse(given.pop("function_size"), base.function_size) if given.get("function_size") else base.function_size
        given.pop("function_size", None)
        limits = base.thresholds | {k: Thresholds.parse(v) for k, v in given.items() if k in base.thresholds}
        hub, clones, display = found.get("hub") or {}, found.get("cpd") or {}, found.get("display") or {}
        disabled = frozenset(found.get("disabled_metrics") or ())
        for m in sorted(disabled - set(METRICS)):
            warnings.warn(f"unknown metric in disabled_metrics: {m}", stacklevel=2)
        return cls(limits, size, display.get("mode", "both"), int(hub.get("min_fan_in", 10)), int(hub.get("min_fan_out", 3)), int(clones.get("min_tokens", 50)), disabled)
