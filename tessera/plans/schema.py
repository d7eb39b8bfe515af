"""Declared input schemas: names, roles, and categorical encodings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class InputSchema:
    """Feature names and their roles.

    Names are given, or ``num_features`` for "0", "1", ...  Of the active features (all but ids and ignored ones) the
    numeric or the categorical ones are given; the others are of the other kind.  A target must be active.
    """

    feature_names: list[str] = field(default_factory=list)
    num_features: int = 0
    id_features: list[str] = field(default_factory=list)
    ignored_features: list[str] = field(default_factory=list)
    numeric_features: list[str] | None = None
    categorical_features: list[str] | None = None
    target_feature: str | None = None

    def __post_init__(self) -> None:
        names = list(self.feature_names) or [str(i) for i in range(self.num_features)]
        if not names:
            raise ValueError("no features are declared")
        if len(set(names)) != len(names):
            raise ValueError("feature names must be unique")
        for kind in (self.id_features, self.ignored_features, self.numeric_features or [], self.categorical_features or []):
            if unknown := set(kind) - set(names):
                raise ValueError(f"unknown features: {sorted(unknown)}")
        object.__setattr__(self, "feature_names", names)
        active = self.active
        if self.numeric_features is None and self.categorical_features is None:
            raise ValueError("numeric or categorical features must be given")
        if self.target_feature is not None and self.target_feature not in active:
            raise ValueError("the target must be an active feature")

    @property
    def active(self) -> list[str]:
        out = set(self.id_features) | set(self.ignored_features)
        return [n for n in self.feature_names if n not in out]

    def is_active(self, name: str | int) -> bool:
        return self._name(name) in self.active

    def is_id(self, name: str | int) -> bool:
        return self._name(name) in self.id_features

    def is_numeric(self, name: str | int) -> bool:
        n = self._name(name)
        return n in self.active and (n in self.numeric_features if self.numeric_features is not None else n not in self.categorical_features)

    def is_categorical(self, name: str | int) -> bool:
        return self.is_active(name) and not self.is_numeric(name)

    def _name(self, name: str | int) -> str:
        return self.feature_names[name] if isinstance(name, int) else name

    @property
    def has_target(self) -> bool:
        return self.target_feature is not None

    @property
    def is_classification(self) -> bool:
        return self.has_target and self.is_categorical(self.target_feature)

    @property
    def target_index(self) -> int:
        if not self.has_target:
            raise ValueError("no target feature")
        return self.feature_names.index(self.target_feature)

    @property
    def predictors(self) -> list[str]:
        return [n for n in self.active if n != self.target_feature]

    def predictor_index(self, feature_index: int) -> int:
        """Predictors are numbered densely in feature order."""
        return self.predictors.index(self.feature_names[feature_index])

    def feature_index(self, predictor_index: int) -> int:
        return self.feature_names.index(self.predictors[predictor_index])

    def struct(self) -> T.StructType:
        """The typed row: numbers are doubles, categories strings; roles stand in the metadata."""
        out = []
        for n in self.feature_names:
            role = "id" if n in self.id_features else "ignored" if n in self.ignored_features else "numeric" if self.is_numeric(n) else "categorical"
            out.append(T.StructField(n, T.DoubleType() if role == "numeric" else T.StringType(), True, {"role": role, "target": n == self.target_feature}))
        return T.StructType(out)

    def typed(self, rows: DataFrame, tokens: str = "tokens") -> DataFrame:
        """Typed columns of tokens; an empty target is missing, ids and ignored ones are null among the features."""
        cols = []
        for i, f in enumerate(self.struct().fields):
            t = F.get(F.col(tokens), i)
            if f.metadata["target"]:
                t = F.when(t != "", t)
            cols.append(t.cast(f.dataType).alias(f.name, metadata=f.metadata))
        return rows.select("*", *cols)

    def vector(self, tokens: Column) -> Column:
        """Active features as an array of doubles, in feature order."""
        return F.array(*[F.get(tokens, i).cast("double") for i, n in enumerate(self.feature_names) if n in self.active])


@dataclass(frozen=True)
class Encodings:
    """A number for each value of each categorical feature, in the order in which the values are given."""

    values: dict[int, list[str]]

    def encoding(self, feature: int) -> dict[str, int]:
        return {v: k for k, v in enumerate(self.values[feature])}

    def value(self, feature: int, code: int) -> str:
        return self.values[feature][code]

    def count(self, feature: int) -> int:
        return len(self.values.get(feature, []))

    def encode(self, feature: int, value: Column) -> Column:
        """The code, null for a value that isn't listed."""
        codes = F.create_map(*[F.lit(x) for v, k in self.encoding(feature).items() for x in (v, k)])
        return F.try_element_at(codes, value)

    def decode(self, feature: int, code: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in self.values[feature]]), code)


def distinct_values(rows: DataFrame, schema: InputSchema) -> Encodings:
    """Sorted values of all categorical features, found in one pass: sets are merged per task, then overall."""
    names = [n for n in schema.feature_names if schema.is_categorical(n)]
    if not names:
        return Encodings({})
    row = rows.agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in names]).first()
    return Encodings({schema.feature_names.index(n): list(row[n]) for n in names})
