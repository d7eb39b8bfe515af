"""Rescorers: what an application changes in the ranking, as Column functions that stay in the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rescorer:
    """``rescore(id, score)`` gives a new score (NaN or null drops the row); ``is_filtered(id)`` drops it before.

    ``on_arrays(ids, scores)`` may give what ``rescore`` gives for an array of ids and a matrix of scores (a row a user, a column an id;
    NaN drops): scores of many users are then rescored as matrices, not as a row a pair.
    """

    rescore: Callable[[Column, Column], Column] | None = None
    is_filtered: Callable[[Column], Column] | None = None
    on_arrays: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def filter_only(self, rows: DataFrame, item: str) -> DataFrame:
        return rows.where(~F.coalesce(self.is_filtered(F.col(item)), F.lit(False))) if self.is_filtered else rows

    def apply(self, rows: DataFrame, item: str, value: str) -> DataFrame:
        rows = self.filter_only(rows, item)
        if self.rescore is None:
            return rows
        new = self.rescore(F.col(item), F.col(value))
        return rows.withColumn(value, new).where(F.col(value).isNotNull() & ~F.isnan(value))


def combined(*rescorers: Rescorer | None) -> Rescorer | None:
    """One after another; filtered if any filters, dropped as soon as one drops; None if there are none."""
    some = [r for r in rescorers if r is not None]
    if not some:
        return None
    if len(some) == 1:
        return some[0]

    def rescore(item: Column, score: Column) -> Column:
        for r in some:
            if r.rescore is not None:
                new = r.rescore(item, score)
                score = F.when(score.isNull() | F.isnan(score), F.lit(float("nan"))).otherwise(new)
        return score

    def is_filtered(item: Column) -> Column:
        out = F.lit(False)
        for r in some:
            if r.is_filtered is not None:
                out = out | F.coalesce(r.is_filtered(item), F.lit(False))
        return out

    def on_arrays(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        for r in some:
            if r.on_arrays is not None:
                scores = np.where(np.isnan(scores), scores, r.on_arrays(ids, scores))
        return scores

    arrays = any(r.rescore for r in some) and all(r.on_arrays for r in some if r.rescore)
    return Rescorer(rescore if any(r.rescore for r in some) else None, is_filtered if any(r.is_filtered for r in some) else None, on_arrays if arrays else None)


@dataclass(frozen=True)
class RescorerProvider:
    """Factories by kind of request; each takes the request's parameters and may give None."""

    recommend: Callable[[list, list[str]], Rescorer | None] = field(default=lambda users, args: None)
    recommend_anonymous: Callable[[list, list[str]], Rescorer | None] = field(default=lambda items, args: None)
    most_popular: Callable[[list[str]], Rescorer | None] = field(default=lambda args: None)
    most_active: Callable[[list[str]], Rescorer | None] = field(default=lambda args: None)
    most_similar: Callable[[list[str]], Rescorer | None] = field(default=lambda args: None)


def providers(*many: RescorerProvider) -> RescorerProvider:
    """A provider whose rescorers are those of all the given ones combined."""
    each = lambda kind: lambda *args: combined(*(getattr(p, kind)(*args) for p in many))
    return RescorerProvider(each("recommend"), each("recommend_anonymous"), each("most_popular"), each("most_active"), each("most_similar"))
