"""Frozen, validated settings."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class RatingConfig:
    initial: float = 1500.0
    k: float = 32.0
    scale: float = 400.0

    def __post_init__(self) -> None:
        for name in ("initial", "k", "scale"):
            value = getattr(self, name)
            _check(math.isfinite(value) and value > 0, f"{name} must be positive and finite")


@dataclass(frozen=True)
class RollingConfig:
    window: int = 10
    schedule_days: int = 14
    neutral_rate: float = 0.5

    def __post_init__(self) -> None:
        _check(self.window > 0 and self.schedule_days > 0, "windows must be positive")
        _check(0 <= self.neutral_rate <= 1, "neutral_rate must lie in [0, 1]")


@dataclass(frozen=True)
class TrainingConfig:
    model_version: str = "model_v1"
    c: float = 1.0
    max_iter: int = 2000
    seed: int = 42

    def __post_init__(self) -> None:
        _check(self.c > 0 and self.max_iter > 0, "c and max_iter must be positive")


@dataclass(frozen=True)
class SplitConfig:
    """Inclusive, ordered, disjoint date ranges by partition."""

    train: tuple[date, date] = (date(2020, 1, 1), date(2023, 12, 31))
    validation: tuple[date, date] = (date(2024, 1, 1), date(2024, 12, 31))
    test: tuple[date, date] = (date(2025, 1, 1), date(2025, 12, 31))

    def __post_init__(self) -> None:
        ranges = (self.train, self.validation, self.test)
        _check(all(a <= b for a, b in ranges), "ranges must be ordered")
        _check(all(x[1] < y[0] for x, y in zip(ranges, ranges[1:])), "ranges must not overlap")


@dataclass(frozen=True)
class Fold:
    fold: int
    train_from: int
    train_to: int
    evaluate: int

    def __post_init__(self) -> None:
        _check(self.train_from <= self.train_to < self.evaluate, "a fold trains before it evaluates")


FOLDS = (Fold(1, 2020, 2022, 2023), Fold(2, 2020, 2023, 2024), Fold(3, 2020, 2024, 2025))


@dataclass(frozen=True)
class ValueThresholds:
    probability: float = 0.55
    edge: float = 0.04
    expected_value: float = 0.03
    min_odds: float = 1.50
    max_odds: float = 3.50

    def __post_init__(self) -> None:
        _check(0 <= self.probability <= 1, "probability must lie in [0, 1]")
        _check(1 < self.min_odds <= self.max_odds, "odds range must be ordered and above 1")


@dataclass(frozen=True)
class BankrollConfig:
    start: float = 10_000.0
    fraction: float = 0.005
    partition: str = "test"
    retirements: str = "void"
    partitions: tuple[str, ...] = field(default=("train", "validation", "test"))

    def __post_init__(self) -> None:
        _check(math.isfinite(self.start) and self.start > 0, "start must be positive")
        _check(0 < self.fraction <= 1, "fraction must lie in (0, 1]")
        _check(self.partition in self.partitions, "unknown partition")
        _check(self.retirements in ("void", "settle"), "unknown retirement policy")
