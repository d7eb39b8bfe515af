import pytest
from pyspark.sql import functions as F

from tessera.plans.search import ContinuousAround, ContinuousRange, DiscreteAround, DiscreteRange, Unordered, best_candidate, domain, grid, random_search
from tessera.sources import store
from tessera.operators import interactions as ix
from tessera.streaming import layers, updates as U


def test_domains():
    assert ContinuousRange(0.0, 1.0).trials(1) == [0.5] and ContinuousRange(0.0, 1.0).trials(3) == [0.0, 0.5, 1.0]
    assert DiscreteRange(0, 10).trials(2) == [0, 10] and DiscreteRange(0, 10).trials(3) == [0, 5, 10] and DiscreteRange(0, 2).trials(9) == [0, 1, 2]
    assert ContinuousAround(1.0, 0.5).trials(3) == [0.5, 1.0, 1.5] and DiscreteAround(10, 2).trials(3) == [8, 10, 12]
    assert domain(["a", "b"]) == Unordered(("a", "b")) and domain([1, 5]) == DiscreteRange(1, 5) and domain([0.5, 5]) == ContinuousRange(0.5, 5.0)
    assert domain(3) == DiscreteRange(3, 3) and domain("x") == Unordered(("x",))


def test_search():
    combos = grid([DiscreteRange(0, 1), Unordered(("a", "b", "c"))], 6)
    assert sorted(combos) == [(a, b) for a in (0, 1) for b in "abc"]
    assert len(grid([DiscreteRange(0, 100), DiscreteRange(0, 100)], 5)) == 5 and grid([], 3) == [()]
    assert all(0 <= v <= 1 for (v,) in random_search([ContinuousRange(0.0, 1.0)], 20))
    with pytest.raises(ValueError):
        grid([DiscreteRange(0, 1)], 65_537)


def test_best_candidate():
    pick = lambda score, **o: best_candidate([(1,), (2,), (3,)], lambda p: p[0], score, parallelism=2, **o)
    assert pick(lambda m: -abs(m - 2)).params == (2,)
    assert pick(lambda m: float("nan") if m == 3 else m).params == (2,)
    assert pick(lambda m: m, threshold=4) is None and pick(None).params == (1,) and pick(None, threshold=0.0) is None


class Counting:
    def __init__(self):
        self.seen = []

    def run_update(self, spark, stamp_ms, new, old):
        self.seen.append((stamp_ms, new.count(), old.count()))


def test_generations(spark, tmp_path):
    app, folder = Counting(), str(tmp_path / "data")
    batch = lambda n: spark.createDataFrame([(str(k), "v") for k in range(n)], layers.LOG_SCHEMA)
    for stamp, n in ((1000, 3), (2000, 0), (3000, 4), (4000, 2)):
        assert layers.generation(app, batch(n), folder, stamp) == (n > 0)
    assert app.seen == [(1000, 3, 0), (3000, 4, 3), (4000, 2, 7)]
    layers.generation(app, batch(5), folder, 4000)  # again: replaces
    assert store.past(spark, folder, layers.LOG_SCHEMA).count() == 12 and store.generations(spark, folder) == [1000, 3000, 4000]
    assert store.delete_old(spark, folder, -1) == [] and store.delete_old(spark, folder, 1, 3_600_000 + 2000) == [1000]
    assert store.delete_old(spark, folder, 0) == [3000, 4000] and store.generations(spark, folder) == []


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(str(k), f"w{k % 3} x") for k in range(30)], layers.LOG_SCHEMA).repartition(3).write.parquet(source)
    app = Counting()
    layers.batch_layer(layers.log_source(spark, source, files_per_batch=1), app, str(tmp_path / "data"), str(tmp_path / "cp")).awaitTermination()
    sizes = [n for _, n, _ in app.seen]
    assert sum(sizes) == 30 and [o for _, _, o in app.seen] == [sum(sizes[:k]) for k in range(len(sizes))]

    class Words:
        def consume(self, updates):
            """Nothing to load."""

        def build_updates(self, new):
            from tessera.operators.words import cooccurrence

            return U.word_messages(cooccurrence(new))

    log = str(tmp_path / "log")
    layers.speed_layer(layers.log_source(spark, source), Words(), lambda rows, epoch: U.publish(rows, log), str(tmp_path / "cp2")).awaitTermination()
    model = spark.createDataFrame([(-1, "MODEL", '{"z":9}')], "seq long, key string, value string")
    got = {r.word: r["count"] for r in U.latest_words(model.unionByName(spark.read.parquet(log))).collect()}
    assert got == {"z": 9, "w0": 1, "w1": 1, "w2": 1, "x": 3}


def test_messages(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0], ["i"]), ("b", [0.5, 0.0], [])], "id string, features array<float>, known array<string>")
    m = [r.value for r in U.vector_messages(v, "X", "known").collect()]
    assert m == ['["X","a",[1.0,2.0],["i"]]', '["X","b",[0.5,0.0]]']
    log = U.vector_messages(v, "X", "known").select(F.monotonically_increasing_id().alias("seq"), "key", "value")
    assert {(r.user, r["item"]) for r in U.known_after(log).collect()} == {("a", "i")}
    assert {r.id: r.features for r in U.latest_vectors(log).collect()} == {"a": [1.0, 2.0], "b": [0.5, 0.0]}
    assert U.model_message("x", "/p") == ("MODEL", "x") and U.model_message("xx", "/p", 1) == ("MODEL-REF", "/p")
    c = spark.createDataFrame([(1, [0.5, 1.0], 7)], "id int, center array<double>, count long")
    row = U.cluster_messages(c).select(F.lit(0).cast("long").alias("seq"), "key", "value")
    assert row.first().value == "[1,[0.5,1.0],7]" and U.latest_clusters(row).first() == (1, [0.5, 1.0], 7)
    leaf = spark.createDataFrame([(0, "r-", {1: 3})], "tree int, node string, counts map<int,long>")
    assert U.leaf_messages(leaf).first().value == '[0,"r-",{"1":3}]'
    store.write_factors(v.select("id", "features"), str(tmp_path / "f"))
    assert {r.id: r.features for r in store.read_factors(spark, str(tmp_path / "f")).collect()} == {"a": [1.0, 2.0], "b": [0.5, 0.0]}


def test_retained(spark):
    rows = [(1, "old", [1.0]), (3, "listed", [2.0]), (12, "recent", [3.0]), (25, "later", [4.0])]
    vectors = spark.createDataFrame(rows, "seq long, id string, features array<float>")
    models = spark.createDataFrame([(10,), (20,)], "seq long")
    listed = spark.createDataFrame([("listed",)], "id string")
    assert {r.id for r in U.retained(vectors, models, listed).collect()} == {"listed", "recent", "later"}


def test_learning_app(spark):
    class Best(layers.LearningApp):
        candidates = 3
        published = None

        @property
        def domains(self):
            return [DiscreteRange(1, 3)]

        def build_model(self, train, params):
            return params[0], train.count()

        def evaluate(self, model, train, test):
            return -abs(model[0] - 2)

        def publish(self, model, new, old, stamp_ms):
            self.published = model

    app = Best()
    new = spark.createDataFrame([(str(k), "v") for k in range(200)], layers.LOG_SCHEMA)
    app.run_update(spark, 1, new, new.limit(50))
    assert app.published[0] == 2 and 200 <= app.published[1] < 250
    app.threshold, app.published = 1.0, None
    assert app.run_update(spark, 1, new, new.limit(0)) is None and app.published is None
    assert layers.load("tessera.streaming.layers.LearningApp") is layers.LearningApp


def test_files(spark, tmp_path):
    import gzip
    import zipfile

    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("x\ny\n")
    assert {r.value for r in store.read_lines(spark, str(tmp_path / "a.txt.gz")).collect()} == {"x", "y"}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.txt", "p\nq\n")
    assert {r.value for r in store.read_zipped(spark, str(tmp_path / "b.zip")).collect()} == {"p", "q"}
    c = tmp_path / "cand" / "1"
    c.mkdir(parents=True)
    (c / "m.json").write_text("{}")
    store.promote(spark, str(c), str(tmp_path / "model"))
    assert (tmp_path / "model" / "m.json").exists() and not (tmp_path / "cand").exists()


def test_generations_are_in_order_however_they_are_partitioned(spark, tmp_path):
    log = str(tmp_path / "ordered")
    for generation, parts in ((1, 4), (2, 1), (3, 7)):
        rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.array(F.lit(float(generation))).alias("features")).repartition(parts)
        U.publish(U.vector_messages(rows, "Y"), log)
    both = spark.read.schema(U.LOG).parquet(log)
    assert [r.seq for r in both.orderBy("seq").collect()] == list(range(150))
    assert {tuple(r.features) for r in U.latest_vectors(both).collect()} == {(3.0,)}
    assert U.append(spark, log, "MODEL", "{}") == 150 and U.next_seq(spark, log, 1000) == 1000
    assert list(tmp_path.iterdir()) == [tmp_path / "ordered"]  # nothing staged is left


def test_strengths_that_are_no_numbers(spark):
    rows = spark.createDataFrame([(["a", "x", "1", "1"],), (["a", "x", "NaN", "2"],), (["b", "x", "NaN", "1"],), (["b", "x", "2", "2"],), (["c", "x", "-3", "1"],)], "tokens array<string>")
    got = lambda **k: {r.user: r.strength for r in ix.aggregated(ix.from_tokens(rows), **k).collect()}
    assert got(is_implicit=True) == {"b": 2.0, "c": -3.0} and got(is_implicit=False) == {"b": 2.0, "c": -3.0}
    assert set(got(is_implicit=True, log_epsilon=1.0)) == {"b"}
