"""k-means: assignment, evaluation, training and incremental updates.  Clusters are (id, center, count)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.vectors import euclidean, mean_vector, scale

#: Points of an exact silhouette.
SILHOUETTE_POINTS = 100_000


def _centers(clusters: DataFrame) -> list[tuple[int, list[float]]]:
    """On the driver: k rows.  In order of id."""
    return [(r.id, list(r.center)) for r in clusters.select("id", "center").orderBy("id").collect()]


def nearest(point: Column, centers: list[tuple[int, list[float]]]) -> Column:
    """(distance, id) of the nearest center, the smaller id of equals.

    The k centers are one literal, so points are neither shuffled nor joined.
    """
    if not centers:
        raise ValueError("no clusters")
    table = F.array(*[F.struct(F.lit(i).cast("int").alias("id"), F.array(*[F.lit(float(v)) for v in c]).alias("center")) for i, c in centers])
    return F.array_min(F.transform(table, lambda c: F.struct(euclidean(point, c["center"]).alias("distance"), c["id"].alias("id"))))


def assign(points: DataFrame, clusters: DataFrame, vector: str = "features") -> DataFrame:
    """Points with cluster_id and distance.  Many clusters (over 2000 numbers) are matched by numpy in Arrow batches."""
    centers = _centers(clusters)
    if sum(len(c) for _, c in centers) <= 2000:
        return points.withColumn("_n", nearest(F.col(vector), centers)).select("*", F.col("_n.id").alias("cluster_id"), F.col("_n.distance").alias("distance")).drop("_n")
    return points.withColumn("_n", _nearest_udf(centers)(F.col(vector).cast("array<double>"))).select("*", F.col("_n.id").alias("cluster_id"), F.col("_n.distance").alias("distance")).drop("_n")


def _nearest_udf(centers: list[tuple[int, list[float]]]):
    ids, table = np.array([i for i, _ in centers], np.int32), np.array([c for _, c in centers], np.float64)

    @F.pandas_udf("id int, distance double")
    def find(points: pd.Series) -> pd.DataFrame:
        if not len(points):
            return pd.DataFrame({"id": pd.Series([], dtype="int32"), "distance": pd.Series([], dtype="float64")})
        x = np.stack(points.to_numpy()).astype(np.float64)
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for k, c in enumerate(table):
            d = ((x - c) ** 2).sum(1)
            closer = d < best
            best[closer], at[closer] = d[closer], k
        return pd.DataFrame({"id": ids[at], "distance": np.sqrt(best)})

    return find


def sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"))


def metrics(assigned: DataFrame) -> DataFrame:
    """cluster_id, count, sum_dist, sum_sq_dist: additive, so partial sums do."""
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"), F.sum("distance").alias("sum_dist"), F.sum(F.col("distance") * F.col("distance")).alias("sum_sq_dist"))


def sum_squared_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum(F.col("distance") * F.col("distance")).alias("sse"))


def _scatter(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    per = metrics(assigned).select("cluster_id", (F.col("sum_dist") / F.col("count")).alias("scatter"))
    return clusters.join(per, clusters.id == per.cluster_id, "left").select("id", "center", F.coalesce("scatter", F.lit(0.0)).alias("scatter"))


def _center_pairs(scatter: DataFrame) -> DataFrame:
    other = scatter.select(F.col("id").alias("id2"), F.col("center").alias("center2"), F.col("scatter").alias("scatter2"))
    # k rows on either side.
    return scatter.crossJoin(F.broadcast(other)).where("id <> id2").withColumn("apart", euclidean(F.col("center"), F.col("center2")))


def davies_bouldin(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / distance."""
    worst = _center_pairs(_scatter(assigned, clusters)).groupBy("id").agg(F.max(F.try_divide(F.col("scatter") + F.col("scatter2"), F.col("apart"))).alias("worst"))
    return clusters.join(worst, "id", "left").agg(F.avg(F.coalesce("worst", F.lit(0.0))).alias("davies_bouldin"))


def dunn(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Least distance between centers over the largest mean distance within a cluster."""
    scatter = _scatter(assigned, clusters)
    inter = _center_pairs(scatter).agg(F.min("apart").alias("inter"))
    return inter.crossJoin(F.broadcast(scatter.agg(F.max("scatter").alias("intra")))).select(F.try_divide("inter", "intra").alias("dunn"))


def silhouette(assigned: DataFrame, vector: str = "features", seed: int = 1) -> DataFrame:
    """Mean silhouette coefficient of at most 100,000 points, exact on those; a lone point counts 0.

    Points are cut into blocks; each pair of blocks is one row, whose distances numpy sums by cluster.
    """
    n = assigned.count()
    if n > SILHOUETTE_POINTS:
        assigned = assigned.sample(False, SILHOUETTE_POINTS / n, seed)
    blocks = max(1, min(64, -(-min(n, SILHOUETTE_POINTS) // 1024)))
    placed = assigned.select(F.monotonically_increasing_id().alias("p"), F.col("cluster_id").cast("int").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    cut = placed.withColumn("b", F.pmod(F.xxhash64("p"), F.lit(blocks))).groupBy("b").agg(F.collect_list(F.struct("p", "c", "v")).alias("rows"))
    left = cut.withColumn("b2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select("b", "b2", "rows")
    right = cut.select(F.col("b").alias("b2"), F.col("rows").alias("rows2"))

    def sums(batches):
        for pdf in batches:
            for mine, theirs in zip(pdf["rows"], pdf["rows2"], strict=True):
                x, y = (np.array([r["v"] for r in part], np.float64) for part in (mine, theirs))
                cy = np.array([r["c"] for r in theirs])
                out = []
                for r, v in zip(mine, x, strict=True):
                    d = np.sqrt(((y - v) ** 2).sum(1))
                    ids, inverse = np.unique(cy, return_inverse=True)
                    out.append(pd.DataFrame({"p": r["p"], "c": r["c"], "other": ids.astype(np.int32), "total": np.bincount(inverse, d), "n": np.bincount(inverse)}))
                yield pd.concat(out, ignore_index=True)

    each = left.join(right, "b2").select("rows", "rows2").mapInPandas(sums, "p long, c int, other int, total double, n long")
    by_cluster = each.groupBy("p", "c", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("c") == F.col("other"), F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)))).alias("a")
    rest = F.min(F.when(F.col("c") != F.col("other"), F.col("total") / F.col("n"))).alias("b")
    points = by_cluster.groupBy("p").agg(own, rest)
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b")).when(F.col("a") > F.col("b"), F.col("b") / F.col("a") - 1).otherwise(0.0)
    return points.agg(F.avg(value).alias("silhouette"))


def evaluate(points: DataFrame, clusters: DataFrame, strategy: str, vector: str = "features") -> float:
    """Larger is better: SSE and Davies-Bouldin are negated."""
    assigned = assign(points, clusters, vector)
    if strategy == "SSE":
        return -sum_squared_error(assigned).first()[0]
    if strategy == "DAVIES_BOULDIN":
        return -davies_bouldin(assigned, clusters).first()[0]
    if strategy == "DUNN":
        return dunn(assigned, clusters).first()[0]
    if strategy == "SILHOUETTE":
        return silhouette(assigned, vector).first()[0]
    raise ValueError(f"no such evaluation strategy: {strategy}")


def train(points: DataFrame, k: int, max_iter: int = 30, init: str = "k-means||", seed: int = 1, vector: str = "features") -> DataFrame:
    """Clusters of a fitted model; clusters without points have count 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=max_iter, initMode=init, seed=seed).fit(rows)
    counts = dict(enumerate(model.summary.clusterSizes))
    table = [(i, [float(v) for v in c], int(counts.get(i, 0))) for i, c in enumerate(model.clusterCenters())]
    return points.sparkSession.createDataFrame(table, "id int, center array<double>, count long")


def speed_update(points: DataFrame, clusters: DataFrame, vector: str = "features") -> DataFrame:
    """id, center, count of the clusters that a micro-batch moves: running means, batch sums by partial aggregation."""
    assigned = assign(points, clusters, vector)
    means = mean_vector(assigned.select("cluster_id", F.col(vector).cast("array<double>").alias("mean")), "mean", ["cluster_id"])
    moved = means.join(sizes(assigned).withColumnRenamed("count", "n"), "cluster_id").join(clusters, F.col("cluster_id") == clusters.id)
    share = F.col("n") / (F.col("count") + F.col("n"))
    step = scale(F.zip_with("mean", "center", lambda m, c: m - c), share)
    return moved.select("id", F.zip_with("center", step, lambda c, s: c + s).alias("center"), (F.col("count") + F.col("n")).alias("count"))
