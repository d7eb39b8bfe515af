"""Hyper-parameter domains, their combinations, and the choice among candidate models."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

MAX_COMBINATIONS = 65_536


def _even(low: float, high: float, n: int) -> list[float]:
    """Middle for one, both ends for two, evenly spaced for more."""
    if n == 1:
        return [(low + high) / 2]
    return [low + (high - low) * k / (n - 1) for k in range(n)]


@dataclass(frozen=True)
class ContinuousRange:
    low: float
    high: float

    def __post_init__(self) -> None:
        if self.low > self.high:
            raise ValueError("a range must not be empty")

    def trials(self, n: int) -> list[float]:
        return [self.low] if self.low == self.high else [*_even(self.low, self.high, n)]

    def draw(self, r: random.Random) -> float:
        return r.uniform(self.low, self.high)

    @property
    def distinct(self) -> float:
        return 1 if self.low == self.high else math.inf


@dataclass(frozen=True)
class ContinuousAround:
    around: float
    step: float

    def trials(self, n: int) -> list[float]:
        return [self.around + self.step * (k - (n - 1) / 2) for k in range(n)]

    def draw(self, r: random.Random) -> float:
        return r.gauss(self.around, self.step)

    @property
    def distinct(self) -> float:
        return math.inf


@dataclass(frozen=True)
class DiscreteRange:
    low: int
    high: int

    def __post_init__(self) -> None:
        if self.low > self.high:
            raise ValueError("a range must not be empty")

    def trials(self, n: int) -> list[int]:
        if self.low == self.high:
            return [self.low]
        if n == 1:
            return [(self.low + self.high) // 2]
        if n > self.high - self.low:
            return [*range(self.low, self.high + 1)]
        inner = [math.floor(self.low + (self.high - self.low) * k / (n - 1) + 0.5) for k in range(1, n - 1)]
        return [self.low, *inner, self.high]

    def draw(self, r: random.Random) -> int:
        return r.randint(self.low, self.high)

    @property
    def distinct(self) -> float:
        return self.high - self.low + 1


@dataclass(frozen=True)
class DiscreteAround:
    around: int
    step: int

    def trials(self, n: int) -> list[int]:
        first = self.around - ((n - 1) * self.step) // 2
        return [first + k * self.step for k in range(n)]

    def draw(self, r: random.Random) -> int:
        return round(r.gauss(self.around, self.step))

    @property
    def distinct(self) -> float:
        return math.inf


@dataclass(frozen=True)
class Unordered:
    values: tuple

    def trials(self, n: int) -> list:
        return [*self.values[:n]]

    def draw(self, r: random.Random):
        return r.choice(self.values)

    @property
    def distinct(self) -> float:
        return len(self.values)


def domain(value):
    """From configuration: a number is fixed, a list of two numbers a range, other lists unordered; whole before real."""
    if isinstance(value, (list, tuple)):
        numbers = [_number(v) for v in value]
        if len(value) == 2 and None not in numbers:
            low, high = numbers
            return DiscreteRange(low, high) if isinstance(low, int) and isinstance(high, int) else ContinuousRange(float(low), float(high))
        return Unordered(tuple(value))
    number = _number(value)
    if number is None:
        return Unordered((value,))
    return DiscreteRange(number, number) if isinstance(number, int) else ContinuousRange(number, number)


def _number(v):
    for kind in (int, float):
        try:
            if kind is int and isinstance(v, float):
                continue
            return kind(v)
        except (TypeError, ValueError):
            pass
    return None


def grid(domains: Sequence, candidates: int, seed: int = 1) -> list[tuple]:
    """Combinations of trial values, about ``candidates`` of them.

    All domains get one value more at a time, as far as they have any, until there are enough combinations; of too
    many the first ``candidates`` are taken, in shuffled order.
    """
    if not 0 < candidates <= MAX_COMBINATIONS:
        raise ValueError(f"candidates must be 1 to {MAX_COMBINATIONS}")
    if not domains:
        return [()]
    per, product = [1] * len(domains), 1
    while product < candidates:
        grown = [min(p + 1, d.distinct) for p, d in zip(per, domains, strict=True)]
        if grown == per:
            break
        per, product = grown, math.prod(grown)
    combos = [*itertools.islice(itertools.product(*[d.trials(int(p)) for d, p in zip(domains, per, strict=True)]), candidates)]
    random.Random(seed).shuffle(combos)
    return combos


def random_search(domains: Sequence, candidates: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [tuple(d.draw(r) for d in domains) for _ in range(candidates)] if domains else [()]


@dataclass(frozen=True)
class Candidate:
    params: tuple
    model: object
    score: float


def best_candidate(combos: Sequence[tuple], build: Callable[[tuple], object], evaluate: Callable[[object], float] | None, *, parallelism: int = 1, threshold: float | None = None) -> Candidate | None:
    """The candidate with the largest score; NaN scores don't count.

    ``evaluate`` None: nothing was held out, so the one model built stands, with a score below any threshold.  None if
    no candidate is left or the best misses the threshold.
    """

    def one(params: tuple) -> Candidate | None:
        model = build(params)
        return None if model is None else Candidate(params, model, evaluate(model) if evaluate else math.nan)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        built = [c for c in pool.map(one, combos if evaluate else combos[:1]) if c is not None]
    if evaluate is None:
        return built[0] if built and threshold is None else None
    scored = [c for c in built if not math.isnan(c.score)]
    best = max(scored, key=lambda c: c.score, default=None)
    return None if best is None or (threshold is not None and best.score < threshold) else best
