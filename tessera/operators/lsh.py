"""Approximate candidates by sign hashes: buckets of vectors, and the buckets near a query's."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.vectors import dot

MAX_HASHES = 16


def _ball(hashes: int, bits: int) -> int:
    """Buckets that differ in at most ``bits`` of ``hashes`` bits."""
    return sum(comb(hashes, b) for b in range(bits + 1))


def choose(sample_rate: float, cores: int) -> tuple[int, int]:
    """(hashes, differing bits allowed): the fewest hashes whose ball of buckets is at most ``sample_rate`` of all.

    The ball's radius is the least that gives every core a bucket; numbers of hashes too small for that don't count.
    """
    radius = {h: next((b for b in range(h + 1) if _ball(h, b) >= cores), None) for h in range(MAX_HASHES + 1)}
    fits = (h for h, b in radius.items() if b is not None and _ball(h, b) <= sample_rate * 2**h)
    best = next(fits, MAX_HASHES)
    return best, radius[best] if radius[best] is not None else best


def hyperplanes(hashes: int, rank: int, seed: int = 1, tries: int = 1000) -> np.ndarray:
    """Random normals, each the best of ``tries`` by its largest cosine to those before: nearly orthogonal."""
    rng = np.random.default_rng(seed)
    out = np.zeros((0, rank))
    for _ in range(hashes):
        draws = rng.standard_normal((tries if len(out) else 1, rank))
        draws /= np.linalg.norm(draws, axis=1, keepdims=True)
        worst = np.abs(draws @ out.T).max(1) if len(out) else np.zeros(1)
        out = np.vstack([out, draws[worst.argmin()]])
    return out


def bucket(vector: Column, planes: np.ndarray) -> Column:
    """The sign bits of a vector: bit i is set if its product with plane i is positive."""
    out = F.lit(0)
    for i, plane in enumerate(planes):
        out = out + F.when(dot(vector, F.array(*[F.lit(float(v)) for v in plane])) > 0, 1 << i).otherwise(0)
    return out.cast("int")


def candidate_buckets(main: int, hashes: int, bits: int) -> list[int]:
    """All buckets within ``bits`` of ``main``, nearer ones first: literals, so partitions can be pruned by them."""
    masks = sorted((m for m in range(1 << hashes) if m.bit_count() <= bits), key=lambda m: (m.bit_count(), m))
    return [main ^ m for m in masks]


@dataclass(frozen=True)
class Hashes:
    """What a top-N query looks at: items whose bucket under ``planes`` differs from the query's in at most ``bits`` bits."""

    planes: np.ndarray
    bits: int

    @classmethod
    def for_rate(cls, sample_rate: float, rank: int, cores: int, seed: int = 1) -> Hashes:
        """So many that about ``sample_rate`` of the items are looked at."""
        hashes, bits = choose(sample_rate, cores)
        return cls(hyperplanes(hashes, rank, seed), bits)

    @property
    def masks(self) -> list[int]:
        return candidate_buckets(0, len(self.planes), self.bits)


def near(items: DataFrame, target: Column, bits: int, column: str = "bucket") -> DataFrame:
    """Items whose bucket differs from ``target`` in at most ``bits`` bits."""
    return items.where(F.bit_count(F.col(column).bitwiseXOR(target)) <= bits)
