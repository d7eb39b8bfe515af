"""Alternating least squares: training, portable factor tables, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.vectors import dot
from tessera.operators.interactions import id_index


def train(pairs: DataFrame, *, rank: int = 10, iterations: int = 10, reg: float = 0.001, alpha: float = 1.0, is_implicit: bool = True, seed: int = 1, blocks: int | None = None, checkpoint_interval: int = 5) -> tuple[DataFrame, DataFrame]:
    """(X, Y): (id, features) of users and items of (user, item, strength).  Ids are numbered in string order.

    ``blocks`` of users and of items: as many as the cluster runs tasks at once (4 to 1,000) where not given.
    """
    from pyspark.ml.recommendation import ALS

    blocks = blocks or min(1000, max(4, pairs.sparkSession.sparkContext.defaultParallelism))

    users, items = id_index(pairs, "user"), id_index(pairs, "item")
    coded = pairs.select(F.col("user").cast("string").alias("user"), F.col("item").cast("string").alias("item"), "strength").join(users.toDF("user", "u"), "user").join(items.toDF("item", "i"), "item").select("u", "i", F.col("strength").cast("float").alias("r"))
    model = ALS(rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=is_implicit, userCol="u", itemCol="i", ratingCol="r", seed=seed, numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=checkpoint_interval).fit(coded)
    x = users.join(model.userFactors.toDF("index", "features"), "index").select("id", "features")
    y = items.join(model.itemFactors.toDF("index", "features"), "index").select("id", "features")
    return x, y


def predict(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs that both tables know, with ``predicted``."""
    return pairs.join(x.toDF("user", "_x"), "user").join(y.toDF("item", "_y"), "item").withColumn("predicted", dot(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def rmse(test: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    return predict(test, x, y).agg(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("strength"), 2))).alias("rmse"))


def area_under_curve(test: DataFrame, x: DataFrame, y: DataFrame, *, sample: bool = True, seed: int = 1) -> DataFrame:
    """Mean over users of the share of (positive, negative) pairs in order; ties count as wrong.

    Negatives are items of the test set that aren't the user's positives: about as many as positives, drawn by hash
    where ``sample``, else all.  Users without negatives don't count.  For each user the two score lists are merged
    by rank, so no pairs are made.
    """
    positive = test.select("user", "item").distinct()
    items = positive.select("item").distinct()
    n_items = items.count()
    if sample:
        wanted = positive.groupBy("user").agg(F.count(F.lit(1)).alias("p"))
        # About three draws a positive among numbered items; duplicates and positives go, then as many as positives stay.
        numbered = id_index(items, "item").select(F.col("index").alias("slot"), F.col("id").alias("item"))
        draws = wanted.select("user", "p", F.explode(F.sequence(F.lit(1), F.col("p") * 3)).alias("k")).withColumn("slot", F.pmod(F.xxhash64("user", "k", F.lit(seed)), F.lit(max(1, n_items))).cast("int"))
        from pyspark.sql import Window

        drawn = draws.join(numbered, "slot").select("user", "p", F.col("item")).distinct()
        free = drawn.join(positive.withColumn("item", F.col("item").cast("string")), ["user", "item"], "left_anti")
        rn = F.row_number().over(Window.partitionBy("user").orderBy(F.xxhash64("item", F.lit(seed)), "item"))
        negative = free.withColumn("_rn", rn).where(F.col("_rn") <= F.col("p")).select("user", F.col("item").cast(dict(positive.dtypes)["item"]).alias("item"))
    else:
        every = F.broadcast(items) if n_items <= 100_000 else items
        negative = positive.select("user").distinct().crossJoin(every).join(positive, ["user", "item"], "left_anti")
    up = predict(positive, x, y).withColumn("is_positive", F.lit(1))
    down = predict(negative, x, y).withColumn("is_positive", F.lit(0))
    both = up.unionByName(down)
    from pyspark.sql import Window

    # Negatives strictly below a score: those up to the last smaller score.
    below = Window.partitionBy("user").orderBy("predicted").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy("user", "predicted")
    ranked = both.withColumn("upto", F.sum(1 - F.col("is_positive")).over(below)).withColumn("same", F.sum(1 - F.col("is_positive")).over(peers))
    per_user = ranked.groupBy("user").agg(F.sum(F.when(F.col("is_positive") == 1, F.col("upto") - F.col("same"))).alias("right"), F.sum("is_positive").alias("p"), F.sum(1 - F.col("is_positive")).alias("n"))
    return per_user.where("p > 0 and n > 0").agg(F.avg(F.col("right") / (F.col("p") * F.col("n"))).alias("auc"))
