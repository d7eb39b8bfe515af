"""Ordered, delete-aware user-item interactions.

A row is (user, item, strength, ts_ms); a null strength deletes the pair.  Deletes and order are handled without
collecting a pair's rows: each pair's last delete is one aggregate, and what follows it is summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MS_PER_DAY = 86_400_000.0


def from_tokens(lines: DataFrame, tokens: str = "tokens") -> DataFrame:
    """user, item, strength (null: delete), ts_ms of tokens user,item,strength,timestamp; malformed numbers fail.

    A strength that is no number (NaN) deletes, as an empty one does.
    """
    t = F.col(tokens)
    strength = F.when(F.get(t, 2) == "", F.lit(None)).otherwise(F.nanvl(F.get(t, 2).cast("double"), F.lit(None).cast("double")))
    return lines.select(F.get(t, 0).alias("user"), F.get(t, 1).alias("item"), strength.alias("strength"), F.get(t, 3).cast("bigint").alias("ts_ms"))


def decayed(rows: DataFrame, factor: float, now_ms: int) -> DataFrame:
    """Strengths times factor to the power of their age in days; those of the future stay."""
    if factor >= 1.0:
        return rows
    age = (F.lit(now_ms) - F.col("ts_ms")) / MS_PER_DAY
    return rows.withColumn("strength", F.when(F.col("ts_ms") < now_ms, F.col("strength") * F.pow(F.lit(factor), age)).otherwise(F.col("strength")))


def above(rows: DataFrame, threshold: float) -> DataFrame:
    """Only strengths over the threshold; deletes go as well."""
    v = F.col("strength")
    return rows.where(v.isNotNull() & ~F.isnan(v) & (v > threshold)) if threshold > 0 else rows


def implicit(rows: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """user, item, strength: the sum after the pair's last delete; pairs that end with a delete go.

    The last delete is found by a window over the pair, which sorts nothing: one shuffle on (user, item).
    """
    pair = Window.partitionBy("user", "item")
    order = F.struct("ts_ms", *(tie or []))
    cut = F.max(F.when(F.col("strength").isNull(), order)).over(pair)
    live = rows.withColumn("_order", order).withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("_order") > F.col("_cut")))
    return live.groupBy("user", "item").agg(F.sum("strength").alias("strength")).where("strength is not null and not isnan(strength)")


def explicit(rows: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """user, item, strength: the pair's last value; pairs that end with a delete go."""
    last = F.max_by(F.struct("strength"), F.struct("ts_ms", *(tie or [])))
    return rows.groupBy("user", "item").agg(last.alias("last")).select("user", "item", F.col("last.strength").alias("strength")).where("strength is not null and not isnan(strength)")


def log_strength(pairs: DataFrame, epsilon: float) -> DataFrame:
    """Strengths of which there is no logarithm go."""
    return pairs.withColumn("strength", F.log1p(F.col("strength") / epsilon)).where("strength is not null and not isnan(strength)")


def aggregated(rows: DataFrame, *, is_implicit: bool, decay: float = 1.0, now_ms: int = 0, zero_threshold: float = 0.0, log_epsilon: float | None = None, tie: list[str] | None = None) -> DataFrame:
    """All steps in the order in which models are built from a log."""
    rows = above(decayed(rows, decay, now_ms), zero_threshold)
    if not is_implicit:
        return explicit(rows, tie)
    pairs = implicit(rows, tie)
    return log_strength(pairs, log_epsilon) if log_epsilon else pairs


def known_items(rows: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """user, item of pairs whose last event isn't a delete."""
    return explicit(rows, tie).select("user", "item")


def counts(known: DataFrame, key: str) -> DataFrame:
    """Known pairs by user or item: (id, count)."""
    return known.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("count"))


def id_index(rows: DataFrame, key: str) -> DataFrame:
    """id, index: distinct ids in ascending string order, from 0.

    Ids are range-partitioned and numbered within partitions; partition offsets are one small aggregate, so no task
    sees all ids.
    """
    ids = rows.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct()
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ids.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id())
    sized = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    # As many rows as partitions.
    offsets = sized.select("_part", (F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    return placed.withColumn("_in", inside).join(F.broadcast(offsets), "_part").select("id", (F.coalesce("before", F.lit(0)) + F.col("_in")).cast("int").alias("index"))


def split_by_time(rows: DataFrame, test_fraction: float) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows before and from max - fraction * (max - min) of the timestamps."""
    if test_fraction <= 0:
        return rows, rows.limit(0)
    if test_fraction >= 1:
        return rows.limit(0), rows
    ends = rows.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).first()
    if ends.hi is None:
        return rows, rows
    at = int(ends.hi - test_fraction * (ends.hi - ends.lo))
    return rows.where(F.col("ts_ms") < at), rows.where(F.col("ts_ms") >= at)


def epoch_ms(stamp: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), stamp)
