"""The packaged applications: recommender, clusters and forests, as batch and speed applications over a log of lines.

Batch applications build, search, evaluate and publish; what they publish goes to a model folder and the update log.
Speed applications load the update log and turn micro-batches into updates.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.parsing import parse_lines
from tessera.operators import als, foldin, forest as rdf, interactions as ix, kmeans, words
from tessera.operators.serving import fraction_loaded
from tessera.plans.endpoints import encoded
from tessera.plans.schema import Encodings, InputSchema, distinct_values
from tessera.plans.search import domain
from tessera.sources import manifest as mf, store
from tessera.streaming import updates as U
from tessera.streaming.layers import LearningApp


@dataclass
class Recommender(LearningApp):
    """Lines user,item,strength,timestamp.  Searched: rank, regularization and, for implicit data, alpha."""

    model_folder: str
    log_path: str
    is_implicit: bool = True
    iterations: int = 10
    decay: float = 1.0
    zero_threshold: float = 0.0
    log_epsilon: float | None = None
    keep_known: bool = True
    params: dict = field(default_factory=lambda: {"rank": 10, "reg": 0.001, "alpha": 1.0})
    test_fraction: float = 0.1
    candidates: int = 1
    parallelism: int = 1
    threshold: float | None = None
    search: str = "grid"
    seed: int = 1
    now_ms: int = 0
    blocks: int | None = None  # of the factorization; as many as the cluster has cores, if not given
    max_inline: int = U.MAX_INLINE

    @property
    def domains(self) -> list:
        return [domain(self.params[k]) for k in ("rank", "reg", *(["alpha"] if self.is_implicit else []))]

    def rows(self, lines: DataFrame) -> DataFrame:
        return ix.from_tokens(parse_lines(lines))

    def pairs(self, lines: DataFrame) -> DataFrame:
        return ix.aggregated(self.rows(lines), is_implicit=self.is_implicit, decay=self.decay, now_ms=self.now_ms, zero_threshold=self.zero_threshold, log_epsilon=self.log_epsilon)

    def split(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """By time, over the new data."""
        stamped = parse_lines(new).withColumn("ts_ms", F.get("tokens", 3).cast("bigint"))
        train, test = ix.split_by_time(stamped, self.test_fraction)
        return train.select(new.columns), test.select(new.columns)

    def build_model(self, train: DataFrame, params: tuple):
        pairs = self.pairs(train)
        if pairs.isEmpty():
            return None
        rank, reg, *alpha = params
        return als.train(pairs, rank=int(rank), iterations=self.iterations, reg=reg, alpha=alpha[0] if alpha else 1.0, is_implicit=self.is_implicit, seed=self.seed, blocks=self.blocks)

    def evaluate(self, model, train: DataFrame, test: DataFrame) -> float:
        x, y = model
        rows = self.pairs(test)
        value = (als.area_under_curve(rows, x, y, seed=self.seed) if self.is_implicit else als.rmse(rows, x, y)).first()[0]
        return math.nan if value is None else value if self.is_implicit else -value

    def publish(self, model, new: DataFrame, old: DataFrame, stamp_ms: int) -> None:
        """Model message first, then items, then users, so that a user's query is complete when it first succeeds."""
        x, y = model
        folder, spark = f"{self.model_folder}/{stamp_ms}", new.sparkSession
        for name, table in (("X", x), ("Y", y)):
            store.write_factors(table, f"{folder}/{name}")
        x, y = (store.read_factors(spark, f"{folder}/{name}") for name in "XY")
        doc = mf.Manifest("als", {"implicit": self.is_implicit, "logStrength": self.log_epsilon is not None, "epsilon": self.log_epsilon, "users": x.count(), "items": y.count()}, {"X": f"{folder}/X", "Y": f"{folder}/Y"})
        U.publish_model(spark, doc.dumps(), folder, self.log_path, stamp_ms, self.max_inline)
        U.publish(U.vector_messages(y, "Y"), self.log_path)
        if self.keep_known:
            seen = ix.known_items(self.rows(new.unionByName(old.select(new.columns))))
            items = seen.groupBy(F.col("user").alias("id")).agg(F.sort_array(F.collect_set("item")).alias("known"))
            U.publish(U.vector_messages(x.join(items, "id"), "X", "known"), self.log_path)
        else:
            U.publish(U.vector_messages(x, "X"), self.log_path)


@dataclass
class RecommenderSpeed:
    """Fold-in updates of micro-batches of lines; nothing before enough of the model is loaded."""

    is_implicit: bool = True
    least_loaded: float = 0.8
    x: DataFrame | None = None
    y: DataFrame | None = None
    loaded: float = 0.0
    epsilon: float | None = None

    def consume(self, updates: DataFrame) -> None:
        last = U.last_model(updates)
        if last is None:
            return
        doc = mf.Manifest.loads(last[1])
        now = U.latest_vectors(updates)
        self.x, self.y = (now.where(F.col("matrix") == m).select("id", "features") for m in "XY")
        expected = doc.extension("users", 0) + doc.extension("items", 0)
        there = self.x.count() + self.y.count()
        self.loaded = 1.0 if not expected else min(1.0, there / expected)
        if doc.extension("logStrength"):
            self.epsilon = doc.extension("epsilon")

    def build_updates(self, new: DataFrame) -> DataFrame:
        spark = new.sparkSession
        if self.x is None or self.loaded < self.least_loaded:
            return spark.createDataFrame([], "key string, value string")
        rows = ix.from_tokens(parse_lines(new))
        pairs = ix.aggregated(rows, is_implicit=self.is_implicit, log_epsilon=self.epsilon)
        moved = foldin.speed_updates(pairs, self.x, self.y, self.is_implicit)
        rows = moved.withColumn("known", F.array("other"))
        return U.vector_messages(rows.where("matrix = 'X'"), "X", "known").unionByName(U.vector_messages(rows.where("matrix = 'Y'"), "Y", "known"))


@dataclass
class Clusters(LearningApp):
    """Lines under a schema without target or categories.  Searched: k."""

    schema: InputSchema
    model_folder: str
    log_path: str
    k: object = 10
    iterations: int = 30
    init: str = "k-means||"
    strategy: str = "SILHOUETTE"
    test_fraction: float = 0.1
    candidates: int = 1
    parallelism: int = 1
    threshold: float | None = None
    search: str = "grid"
    seed: int = 1
    max_inline: int = U.MAX_INLINE

    def __post_init__(self) -> None:
        if self.schema.has_target or any(self.schema.is_categorical(n) for n in self.schema.active):
            raise ValueError("clusters need numeric features and no target")

    @property
    def domains(self) -> list:
        return [domain(self.k)]

    def points(self, lines: DataFrame) -> DataFrame:
        return parse_lines(lines).select(self.schema.vector(F.col("tokens")).alias("features"))

    def build_model(self, train: DataFrame, params: tuple) -> DataFrame:
        return kmeans.train(self.points(train), int(params[0]), self.iterations, self.init, self.seed)

    def evaluate(self, model: DataFrame, train: DataFrame, test: DataFrame) -> float:
        return kmeans.evaluate(self.points(train.unionByName(test)), model, self.strategy)

    def publish(self, model: DataFrame, new: DataFrame, old: DataFrame, stamp_ms: int) -> None:
        rows = [(r.id, list(r.center), r["count"]) for r in model.orderBy("id").collect()]
        model.write.mode("overwrite").parquet(f"{self.model_folder}/{stamp_ms}")
        U.publish_model(new.sparkSession, mf.clusters_xml(rows), f"{self.model_folder}/{stamp_ms}-message", self.log_path, stamp_ms, self.max_inline)


@dataclass
class ClustersSpeed:
    schema: InputSchema
    clusters: DataFrame | None = None

    def consume(self, updates: DataFrame) -> None:
        last = U.last_model(updates)
        if last is not None:
            spark = updates.sparkSession
            base = spark.createDataFrame(mf.clusters_from_xml(last[1]), "id int, center array<double>, count long")
            moved = U.latest_clusters(updates.where(F.col("seq") > last[0]))
            self.clusters = base.join(moved.select("id"), "id", "left_anti").unionByName(moved)

    def build_updates(self, new: DataFrame) -> DataFrame:
        points = parse_lines(new).select(self.schema.vector(F.col("tokens")).alias("features"))
        return U.cluster_messages(kmeans.speed_update(points, self.clusters))


@dataclass
class Forests(LearningApp):
    """Lines under a schema with a target.  Searched: depth, bins and impurity."""

    schema: InputSchema
    model_folder: str
    log_path: str
    trees: int = 20
    params: dict = field(default_factory=lambda: {"depth": 8, "bins": 100, "impurity": "entropy"})
    test_fraction: float = 0.1
    candidates: int = 1
    parallelism: int = 1
    threshold: float | None = None
    search: str = "grid"
    seed: int = 1
    max_inline: int = U.MAX_INLINE

    @property
    def domains(self) -> list:
        return [domain(self.params[k]) for k in ("depth", "bins", "impurity")]

    def table(self, lines: DataFrame, codes: Encodings) -> DataFrame:
        """f0, f1, ... (predictors) and y."""
        s = self.schema
        t = F.get("tokens", s.target_index)
        y = codes.encode(s.target_index, t) if s.is_classification else F.when(t != "", t).cast("double")
        rows = parse_lines(lines)
        return rows.select(*[c.cast("double").alias(f"f{k}") for k, c in enumerate(encoded(s, codes, F.col("tokens")))], y.alias("y")).where("y is not null")

    def build_model(self, train: DataFrame, params: tuple) -> tuple[rdf.Forest, Encodings]:
        s = self.schema
        codes = distinct_values(s.typed(parse_lines(train)), s)
        depth, bins, impurity = params
        categories = {k: codes.count(s.feature_index(k)) for k, n in enumerate(s.predictors) if s.is_categorical(n)}
        names = [f"f{k}" for k in range(len(s.predictors))]
        forest = rdf.train(self.table(train, codes).na.drop(), names, "y", classes=codes.count(s.target_index) if s.is_classification else None, categories=categories, trees=self.trees, depth=int(depth), bins=int(bins), impurity=str(impurity) if s.is_classification else "variance", seed=self.seed)
        return forest, codes

    def evaluate(self, model, train: DataFrame, test: DataFrame) -> float:
        forest, codes = model
        rows = self.table(test, codes)
        fs = [F.col(f"f{k}") for k in range(len(self.schema.predictors))]
        if self.schema.is_classification:
            return rdf.accuracy(rows.withColumn("p", rdf.classify(forest, fs)), "p", "y").first()[0]
        value = rdf.rmse(rows.withColumn("p", rdf.regress(forest, fs)), "p", "y").first()[0]
        return math.nan if value is None else -value

    def publish(self, model, new: DataFrame, old: DataFrame, stamp_ms: int) -> None:
        forest, codes = model
        spark = new.sparkSession
        rdf.to_table(spark, forest).write.mode("overwrite").parquet(f"{self.model_folder}/{stamp_ms}")
        doc = json.dumps({"forest": mf.forest_xml(forest), "encodings": {str(k): v for k, v in codes.values.items()}})
        U.publish_model(spark, doc, f"{self.model_folder}/{stamp_ms}-message", self.log_path, stamp_ms, self.max_inline)


def forest_of(value: str) -> tuple[rdf.Forest, Encodings]:
    """What a model message of forests holds."""
    d = json.loads(value)
    return mf.forest_from_xml(d["forest"]), Encodings({int(k): v for k, v in d["encodings"].items()})


@dataclass
class ForestsSpeed:
    schema: InputSchema
    forest: rdf.Forest | None = None
    codes: Encodings | None = None

    def consume(self, updates: DataFrame) -> None:
        last = U.last_model(updates)
        if last is not None:
            self.forest, self.codes = forest_of(last[1])

    def build_updates(self, new: DataFrame) -> DataFrame:
        s = self.schema
        t = F.get("tokens", s.target_index)
        y = self.codes.encode(s.target_index, t) if s.is_classification else F.when(t != "", t).cast("double")
        rows = parse_lines(new).withColumn("y", y)
        features = encoded(s, self.codes, F.col("tokens"))
        make = rdf.class_updates if s.is_classification else rdf.mean_updates
        return U.leaf_messages(make(rows, self.forest, features, "y"))


@dataclass
class WordCounts:
    """The example application: co-occurrence counts of all lines, then of micro-batches on top.

    Counts stay a table, next to the log, that the model's message names: no row holds the whole vocabulary.
    """

    log_path: str
    model: DataFrame | None = None

    def run_update(self, spark: SparkSession, stamp_ms: int, new: DataFrame, old: DataFrame) -> None:
        counts = words.cooccurrence(new.select("value").unionByName(old.select("value")))
        folder = f"{self.log_path.rstrip('/')}.models/{stamp_ms}"
        counts.write.mode("overwrite").parquet(folder)
        U.append(spark, self.log_path, "MODEL-REF", folder, stamp_ms)

    def consume(self, updates: DataFrame) -> None:
        self.model = U.latest_words(updates)

    def build_updates(self, new: DataFrame) -> DataFrame:
        return U.word_messages(words.updated(self.model, new))


def loaded_enough(log: DataFrame, expected: DataFrame, least: float = 0.8) -> bool:
    """Whether enough of the listed ids have arrived for queries to be answered."""
    return fraction_loaded(expected, U.latest_vectors(log).select("id")) >= least
