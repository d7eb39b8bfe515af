"""What serving endpoints answer for lines of input: a table of lines in, a table of answers out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.parsing import ingest, parse_lines
from tessera.operators import forest as rdf, kmeans
from tessera.operators.serving import BadRequestError, NotFoundError
from tessera.plans.schema import Encodings, InputSchema


class ReadOnlyError(PermissionError):
    """The serving side takes no input."""


def append_lines(lines: DataFrame, log_path: str, column: str = "value", read_only: bool = False) -> None:
    """Lines to the input log; the key is a hash of the line."""
    if read_only:
        raise ReadOnlyError("input isn't accepted")
    lines.select(F.hex(F.xxhash64(column)).alias("key"), F.col(column).alias("value")).write.mode("append").parquet(log_path)


def ingest_lines(lines: DataFrame, log_path: str, now_ms: int, read_only: bool = False) -> None:
    """user,item[,strength[,timestamp]] lines, checked and completed; any bad line rejects all."""
    done = parse_lines(lines).select(ingest(F.col("tokens"), F.lit(now_ms)).alias("value"))
    if not done.where("value is null").isEmpty():
        raise BadRequestError("a line isn't user,item[,strength[,timestamp]]")
    append_lines(done, log_path, read_only=read_only)


def preference(spark, user: str, item: str, strength: str | None, log_path: str, now_ms: int, read_only: bool = False) -> None:
    """One preference (none given: 1), or its deletion (strength "")."""
    value = "1" if strength is None else strength
    rows = spark.createDataFrame([([user, item, value],)], "tokens array<string>")
    done = rows.select(ingest(F.col("tokens"), F.lit(now_ms)).alias("value"))
    if done.first().value is None:
        raise BadRequestError(f"no strength: {strength}")
    append_lines(done, log_path, read_only=read_only)


def encoded(schema: InputSchema, encodings: Encodings, tokens: Column) -> list[Column]:
    """Predictors as columns, in their order: numbers, or codes of categories; missing or unknown ones are null."""
    out = []
    for name in schema.predictors:
        i = schema.feature_names.index(name)
        t = F.get(tokens, i)
        out.append(F.when(t != "", t).try_cast("double") if schema.is_numeric(name) else encodings.encode(i, t))
    return out


def _checked(lines: DataFrame, schema: InputSchema) -> DataFrame:
    """Tokens of lines; a line of another length is a bad request, which shows when the answer is computed."""
    n = len(schema.feature_names)
    return parse_lines(lines).withColumn("tokens", F.when(F.size("tokens") == n, F.col("tokens")).otherwise(F.raise_error(F.lit(f"a line needs {n} values"))))


def predict_lines(lines: DataFrame, forest: rdf.Forest, schema: InputSchema, encodings: Encodings) -> DataFrame:
    """Lines with ``prediction``: the class's name, or the number, as strings."""
    rows = _checked(lines, schema)
    features = encoded(schema, encodings, F.col("tokens"))
    if schema.is_classification:
        value = encodings.decode(schema.target_index, rdf.classify(forest, features))
    else:
        value = rdf.regress(forest, features).cast("string")
    return rows.withColumn("prediction", value)


def distribution_lines(lines: DataFrame, forest: rdf.Forest, schema: InputSchema, encodings: Encodings) -> DataFrame:
    """Lines with (class, probability) in the order of encodings."""
    if not schema.is_classification:
        raise BadRequestError("only classification has distributions")
    rows = _checked(lines, schema)
    p = rdf.distribution(forest, encoded(schema, encodings, F.col("tokens")))
    names = encodings.values[schema.target_index]
    return rows.withColumn("p", p).withColumn("distribution", F.array(*[F.struct(F.lit(n).alias("class"), F.get("p", k).alias("probability")) for k, n in enumerate(names)])).drop("p")


def importance(forest: rdf.Forest, schema: InputSchema, feature: int | None = None) -> list[float] | float:
    """By feature, 0 for those that are no predictors; or of one."""
    every = [forest.importances[schema.predictor_index(i)] if n in schema.predictors else 0.0 for i, n in enumerate(schema.feature_names)]
    if feature is None:
        return every
    if not 0 <= feature < len(every):
        raise NotFoundError(f"no feature {feature}")
    return every[feature]


def assign_lines(lines: DataFrame, clusters: DataFrame, schema: InputSchema) -> DataFrame:
    """Lines with cluster_id and distance."""
    return kmeans.assign(_checked(lines, schema).withColumn("features", schema.vector(F.col("tokens"))), clusters)


def user_or_404(users: DataFrame, user) -> DataFrame:
    """The row of one user; NotFoundError without one."""
    row = users.where(F.col("id") == user)
    if row.isEmpty():
        raise NotFoundError(str(user))
    return row
