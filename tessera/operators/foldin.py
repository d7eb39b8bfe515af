"""Fold-in: how one interaction moves a user's or an item's vector, without training anew."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.vectors import Solver, add, dot, gramian_matrix, solver


def target_estimate(value: Column, current: Column, is_implicit: bool = True) -> Column:
    """The score an interaction asks for, null for no change.

    Implicit: a positive value moves the score towards 1, a negative one towards 0, by value / (1 + value) of the
    rest; explicit: the value itself.
    """
    if not is_implicit:
        return value
    up = current + value / (1 + value) * (1 - F.greatest(F.lit(0.0), current))
    down = current + value / (value - 1) * (-F.least(F.lit(1.0), current))
    return F.when((value > 0) & (current < 1), up).when((value < 0) & (current > 0), down)


def target_estimate_value(value: float, current: float, is_implicit: bool = True) -> float | None:
    if not is_implicit:
        return value
    if value > 0 and current < 1:
        return current + value / (1 + value) * (1 - max(0.0, current))
    if value < 0 and current > 0:
        return current + value / (value - 1) * -min(1.0, current)
    return None


def matrix_times(matrix: np.ndarray, vector: Column) -> Column:
    """A literal matrix times a vector column."""
    return F.array(*[dot(F.array(*[F.lit(float(v)) for v in row]), vector) for row in matrix])


def folded(value: Column, mine: Column, other: Column, inverse: np.ndarray, is_implicit: bool = True) -> Column:
    """The new vector of ``mine`` after ``value`` with ``other``; null where nothing changes.

    Without a vector the score counts as 0, and the target starts from 0.5.
    """
    has = mine.isNotNull()
    score = F.when(has, dot(mine, other)).otherwise(0.0)
    target = target_estimate(value, F.when(has, score).otherwise(0.5), is_implicit)
    move = matrix_times(inverse, F.transform(other, lambda v: v.cast("double") * (target - score)))
    new = F.when(has, add(F.transform(mine, lambda v: v.cast("double")), move)).otherwise(move)
    return F.when(other.isNotNull() & target.isNotNull(), F.transform(new, lambda v: v.cast("float")))


def fold_in_value(solve: Solver, value: float, mine: np.ndarray | None, other: np.ndarray | None, is_implicit: bool = True) -> np.ndarray | None:
    """One fold-in on the driver."""
    if other is None:
        return None
    score = 0.0 if mine is None else float(np.asarray(mine, np.float64) @ np.asarray(other, np.float64))
    target = target_estimate_value(value, 0.5 if mine is None else score, is_implicit)
    if target is None:
        return None
    move = solve.solve(np.asarray(other, np.float64) * (target - score))
    return (move if mine is None else np.asarray(mine, np.float64) + move).astype(np.float32)


def profiles(requests: DataFrame, items: DataFrame, users: DataFrame | None = None, solve: Solver | None = None, is_implicit: bool = True) -> DataFrame:
    """request, features of requests (request, position, item, weight[, user]): fold-ins one after another.

    Starts from the user's vector where ``users`` is given, else from nothing.  Items that the model lacks are passed
    over; requests without any known item go.  Each request's few items are one group, folded in their order.
    """
    import pandas as pd

    solve = solve or solver(gramian_matrix(items))
    rows = requests.join(items.select(F.col("id").alias("item"), F.col("features").alias("y")), "item")
    if users is not None:
        rows = rows.join(users.select(F.col("id").alias("user"), F.col("features").alias("x")), "user", "left")
    else:
        rows = rows.withColumn("x", F.lit(None).cast("array<float>"))
    kind = dict(requests.dtypes)["request"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        x = pdf["x"].iloc[0]
        x = None if x is None else np.asarray(x)
        for w, y in zip(pdf["weight"], pdf["y"], strict=True):
            new = fold_in_value(solve, float(w), x, np.asarray(y), is_implicit)
            x = x if new is None else new
        out = pd.DataFrame({"request": pdf["request"].iloc[:1], "features": [x]})
        return out[out["features"].notna()]

    return rows.select("request", "position", "weight", "x", "y").groupBy("request").applyInPandas(fold, f"request {kind}, features array<float>")


def speed_updates(pairs: DataFrame, users: DataFrame, items: DataFrame, is_implicit: bool = True) -> DataFrame:
    """matrix ('X' or 'Y'), id, features, other: both sides' updates of aggregated (user, item, strength) pairs.

    Both use the vectors from before the batch; X moves by the items' solver, Y by the users'.
    """
    by_items, by_users = solver(gramian_matrix(items)), solver(gramian_matrix(users))
    both = pairs.join(users.select(F.col("id").alias("user"), F.col("features").alias("x")), "user", "left").join(items.select(F.col("id").alias("item"), F.col("features").alias("y")), "item", "left")
    x = both.select(F.lit("X").alias("matrix"), F.col("user").alias("id"), folded(F.col("strength"), F.col("x"), F.col("y"), by_items.inverse, is_implicit).alias("features"), F.col("item").alias("other"))
    y = both.select(F.lit("Y").alias("matrix"), F.col("item").alias("id"), folded(F.col("strength"), F.col("y"), F.col("x"), by_users.inverse, is_implicit).alias("features"), F.col("user").alias("other"))
    return x.unionByName(y).where("features is not null")


def latest(vectors: DataFrame) -> DataFrame:
    """id, features with the largest seq of each id."""
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return vectors.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
