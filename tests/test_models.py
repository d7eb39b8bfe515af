import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import forest as rdf, kmeans
from tessera.plans.schema import Encodings, InputSchema, distinct_values
from tessera.sources import manifest

CLUSTERS = [(0, [1.0, 0.0], 1), (1, [2.0, -1.0], 2), (2, [-1.0, 0.0], 3)]
POINTS = [(1.0, 0.0), (2.0, -2.0), (2.0, 0.0), (-2.0, 0.0), (-0.5, -1.0), (-0.5, 1.0)]


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame(CLUSTERS, "id int, center array<double>, count long")


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([([*p],) for p in POINTS], "features array<double>")


def test_cluster_evaluation(points, clusters):
    want = {"SSE": -5.5, "DUNN": 1.3110480733464633, "DAVIES_BOULDIN": -0.9702216688254247, "SILHOUETTE": 0.30648167401009796}
    assert {s: kmeans.evaluate(points, clusters, s) for s in want} == {k: pytest.approx(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        kmeans.evaluate(points, clusters, "other")


def test_assign(spark):
    served = spark.createDataFrame([(2, [1.0, 0.0], 1), (3, [2.0, -1.0], 2), (4, [-1.0, 0.0], 3)], "id int, center array<double>, count long")
    asked = spark.createDataFrame([([1.0, 0.0],), ([10.0, -1.0],), ([-1.5, 0.5],), ([-1.0, 0.0],)], "features array<double>")
    got = kmeans.assign(asked, served).collect()
    assert [r.cluster_id for r in got] == [2, 3, 4, 4]
    assert [r.distance for r in got][:2] == [0.0, 8.0]


def test_many_centers_by_numpy(spark, points):
    many = spark.createDataFrame([(k, [math.sin(k), math.cos(k)], 1) for k in range(1100)], "id int, center array<double>, count long")
    got = [(r.cluster_id, r.distance) for r in kmeans.assign(points, many).collect()]
    for p, (i, d) in zip(POINTS, got, strict=True):
        best = min(range(1100), key=lambda k: (math.dist(p, (math.sin(k), math.cos(k))), k))
        assert i == best and d == pytest.approx(math.dist(p, (math.sin(best), math.cos(best))))


def test_speed_update(spark, clusters):
    batch = spark.createDataFrame([([1.0, 1.0],)] * 100 + [([2.0, -2.0],)] * 100 + [([-2.0, 0.0],)] * 100, "features array<double>")
    got = {r.id: (r.center, r["count"]) for r in kmeans.speed_update(batch, clusters).collect()}
    assert {i: n for i, (_, n) in got.items()} == {0: 101, 1: 102, 2: 103}
    assert got[0][0] == pytest.approx([1.0, 100 / 101]) and got[2][0] == pytest.approx([-1 - 100 / 103, 0.0])


def test_training(spark):
    rows = spark.createDataFrame([([float(k % 3 * 10), float(k % 2)],) for k in range(60)], "features array<double>")
    model = kmeans.train(rows, 3)
    assert model.agg(F.sum("count")).first()[0] == 60 and model.count() == 3


def classifier():
    leaf = lambda *c: rdf.Node(class_counts=[float(v) for v in c])
    one = rdf.Node(feature=0, categories=[1], default_positive=True, positive=leaf(10, 30, 50), negative=leaf(1, 2, 3))
    two = rdf.Node(feature=1, threshold=-3.0, positive=leaf(1000, 10000, 100000), negative=leaf(100, 400, 900))
    return rdf.Forest([one, two], [1.0, 2.0], [0.1, 0.3])


def test_forest_votes(spark):
    rows = spark.createDataFrame([(1, 0.0), (0, -5.0), (None, None)], "f0 int, f1 double")
    fs = [F.col("f0"), F.col("f1")]
    got = rows.select(rdf.distribution(classifier(), fs).alias("p"), rdf.classify(classifier(), fs).alias("c"), rdf.leaf_path(classifier().trees[0], fs).alias("leaf")).collect()
    assert got[0].p[0] == pytest.approx((10 / 90 + 2 * 1000 / 111000) / 3)
    assert got[1].p[0] == pytest.approx((1 / 6 + 2 * 100 / 1400) / 3)
    assert [r.c for r in got] == [2, 2, 2] and [r.leaf for r in got] == ["r+", "r-", "r+"]


def test_forest_means(spark):
    leaf = lambda m: rdf.Node(mean=m)
    f = rdf.Forest([rdf.Node(feature=0, categories=[1], default_positive=True, positive=leaf(10.0), negative=leaf(1.0)), rdf.Node(feature=1, threshold=-3.0, positive=leaf(1000.5), negative=leaf(100.0))], [1.0, 2.0])
    rows = spark.createDataFrame([(1, 0.0), (0, -5.0)], "f0 int, f1 double")
    fs = [F.col("f0"), F.col("f1")]
    assert [r.p for r in rows.select(rdf.regress(f, fs).alias("p")).collect()] == pytest.approx([(10 + 2 * 1000.5) / 3, 201 / 3])
    assert rows.select(rdf.regress(f, fs, truncate=True).alias("p")).first().p == pytest.approx((10 + 2000) / 3)


def test_forest_round_trips(spark):
    f = classifier()
    back = rdf.from_table(rdf.to_table(spark, f), f.weights, f.importances)
    assert back == f and manifest.forest_from_xml(manifest.forest_xml(f)) == f
    assert rdf.find(f.trees[0], "r+").class_counts == [10, 30, 50]
    with pytest.raises(KeyError):
        rdf.find(f.trees[0], "r++")
    assert manifest.clusters_from_xml(manifest.clusters_xml(CLUSTERS)) == CLUSTERS
    m = manifest.Manifest("als", {"rank": 2, "ids": ["a"]}, {"X": "/x"})
    assert manifest.Manifest.loads(m.dumps()) == m
    assert manifest.redacted({"a": 1, "b": {"my-password": "x"}}) == {"a": 1, "b": {"my-password": "*****"}}


def test_forest_updates(spark):
    rows = spark.createDataFrame([(1, 0.0, 2), (1, -4.0, 0), (0, 1.0, 1)], "f0 int, f1 double, y int")
    fs = [F.col("f0"), F.col("f1")]
    f = rdf.updated(classifier(), rdf.class_updates(rows, classifier(), fs, "y").collect())
    assert f.trees[0].positive.class_counts == [11, 30, 51] and f.trees[1].negative.class_counts == [101, 400, 900]
    counts = {(r.tree, r.node): r["count"] for r in rdf.node_counts(rows, classifier(), fs).collect()}
    assert counts == {(0, "r"): 3, (0, "r+"): 2, (0, "r-"): 1, (1, "r"): 3, (1, "r+"): 2, (1, "r-"): 1}
    imp = {r.feature: r.importance for r in rdf.importances(rows, classifier(), fs, 3).collect()}
    assert imp == {0: 0.5, 1: 0.5, 2: 0.0}


def test_forest_training(spark):
    rows = [(float(a), float(b), b % 3, int(a > 5)) for a in range(12) for b in range(6)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 int, y int").cache()
    f = rdf.train(df, ["f0", "f1", "f2"], "y", classes=2, categories={2: 3}, trees=5, depth=4)
    fs = [F.col(c) for c in ("f0", "f1", "f2")]
    assert rdf.accuracy(df.withColumn("p", rdf.classify(f, fs)), "p", "y").first()[0] == 1.0
    assert f.importances[0] == max(f.importances)
    assert rdf.accuracy(df.limit(0).withColumn("p", F.col("y")), "p", "y").first()[0] == 0.0


def test_schema(spark):
    s = InputSchema(num_features=5, id_features=["0"], categorical_features=["4"], target_feature="4")
    rows = spark.createDataFrame([(["x", "1", "2.5", "-3.2", "B"],), (["x", "1", "1", "1", ""],)], "tokens array<string>")
    typed = s.typed(rows.limit(1)).first()
    assert (typed["1"], typed["2"], typed["3"], typed["4"]) == (1.0, 2.5, -3.2, "B")
    assert s.is_classification and s.predictors == ["1", "2", "3"] and s.predictor_index(3) == 2 and s.feature_index(0) == 1
    e = Encodings({4: ["A", "B"]})
    assert rows.limit(1).select(e.encode(4, F.get("tokens", 4)).alias("c")).first().c == 1
    assert rows.limit(1).select(e.decode(4, F.lit(1)).alias("v"), e.encode(4, F.lit("Z")).alias("z")).first() == ("B", None)
    k = InputSchema(num_features=4, ignored_features=["0", "2"], categorical_features=[])
    assert rows.limit(1).select(k.vector(F.array(F.lit("a"), F.lit("2.0"), F.lit("b"), F.lit("-3.5"))).alias("v")).first().v == [2.0, -3.5]
    assert distinct_values(spark.createDataFrame([("b",), ("a",)], "c string"), InputSchema(feature_names=["c"], categorical_features=["c"])).values == {0: ["a", "b"]}
    for bad in (dict(), dict(feature_names=["a", "a"], numeric_features=[]), dict(feature_names=["a"]), dict(feature_names=["a"], numeric_features=["a"], ignored_features=["a"], target_feature="a")):
        with pytest.raises(ValueError):
            InputSchema(**bad)
