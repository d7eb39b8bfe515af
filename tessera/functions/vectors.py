"""Vector functions as Column builders, and the small dense solves that stay on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def dot(x: Column, y: Column) -> Column:
    """Dot product; elements are widened to double before they are multiplied."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(x: Column, y: Column, norm_y: Column | None = None) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(x, y), norm(x) * (norm(y) if norm_y is None else norm_y))


def unit(x: Column) -> Column:
    """Scaled to length 1; null for a zero vector."""
    length = norm(x)
    return F.when(length > 0, scale(x, F.lit(1.0) / length))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(squared_distance(x, y))


def squared_distance(x: Column, y: Column) -> Column:
    apart = F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))
    return F.aggregate(apart, F.lit(0.0), lambda s, v: s + v * v)


def parse_vector(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t.cast("double"))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") * by)


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate: sum of weighted values over the sum of weights; null without weight."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total != 0, F.sum(value * weight) / total)


def mean_vector(df: DataFrame, vector: str, keys: list[str], mean: bool = True) -> DataFrame:
    """Element-wise mean (or sum) of a vector column by ``keys``: rows (keys..., vector).

    Partial aggregates are one number per key and dimension, whatever the number of rows.
    """
    each = df.select(*keys, F.posexplode(vector).alias("dim", "v"))
    agg = F.avg(F.col("v").cast("double")) if mean else F.sum(F.col("v").cast("double"))
    by_dim = each.groupBy(*keys, "dim").agg(agg.alias("v"))
    return by_dim.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias(vector))


def gramian(vectors: DataFrame, column: str = "features") -> DataFrame:
    """Lower triangle of V'V as rows (i, j, value).

    Each Arrow batch adds up its own product; partial products of rank x rank numbers meet in one aggregation.
    """
    import pandas as pd

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf[column].to_numpy()).astype(np.float64)
                g = m.T @ m
                total = g if total is None else total + g
        if total is not None:
            i, j = np.tril_indices(len(total))
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "value": total[i, j]})

    part = vectors.select(F.col(column).cast("array<double>").alias(column)).where(F.col(column).isNotNull()).mapInPandas(partial, "i int, j int, value double")
    return part.groupBy("i", "j").agg(F.sum("value").alias("value"))


def gramian_matrix(vectors: DataFrame, column: str = "features") -> np.ndarray:
    """V'V on the driver: rank x rank numbers."""
    rows = gramian(vectors, column).collect()
    n = 1 + max((r.i for r in rows), default=-1)
    out = np.zeros((n, n))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


class SingularMatrixError(ValueError):
    """The system can't be solved; ``rank`` is the matrix's apparent rank."""

    def __init__(self, rank: int):
        super().__init__(f"apparent rank is {rank}")
        self.rank = rank


@dataclass
class Solver:
    """Solves A x = b for a symmetric matrix that was checked once."""

    inverse: np.ndarray

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self.inverse @ np.asarray(b, np.float64)


def solver(matrix: np.ndarray, threshold: float = 1e-5) -> Solver:
    """Check the rank by pivoted QR against ``threshold`` times the matrix's largest column sum, then invert."""
    a = np.array(matrix, np.float64)
    tolerance = threshold * np.abs(a).sum(0).max(initial=0.0)
    rank = pivoted_rank(a, tolerance)
    if rank < len(a):
        raise SingularMatrixError(rank)
    return Solver(np.linalg.inv(a))


def pivoted_rank(matrix: np.ndarray, tolerance: float) -> int:
    """Number of pivots of a column-pivoted orthogonalisation before what is left falls below the tolerance."""
    left = np.array(matrix, np.float64)
    for rank in range(left.shape[1]):
        sizes = np.linalg.norm(left, axis=0)
        if np.linalg.norm(left) < tolerance or sizes.max() == 0:
            return rank
        q = left[:, int(sizes.argmax())] / sizes.max()
        left = left - np.outer(q, q @ left)
    return left.shape[1]


def random_vector(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(dims)
