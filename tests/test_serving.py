"""A fixed model of 7 users and 9 items of rank 2, with expected answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import solver
from tessera.operators import foldin, interactions as ix, lsh, serving, words
from tessera.operators.rescoring import Rescorer, RescorerProvider, combined, providers

X = {"U0": [-0.35837504, 0.60391283], "U1": [-0.7757129, 0.4327127], "U2": [-0.7757129, -0.4327127], "U3": [-0.35837504, -0.60391283], "U4": [-1.1340879, 1.0366255], "U5": [-1.5514258, -3.5398357e-16], "U6": [-1.1340879, -1.0366255]}
Y = {"I0": [-0.23176478, 0.504302], "I1": [-0.53749436, 0.45167503], "I2": [-0.53749436, -0.45167503], "I3": [-0.23176478, -0.504302], "I4": [-0.7692591, 0.9559771], "I5": [-1.0749887, 1.0619507e-16], "I6": [-0.7692591, -0.9559771], "I7": [-1.3067534, 0.504302], "I8": [-1.3067534, -0.504302]}
KNOWN = {"U0": "047", "U1": "14578", "U2": "25678", "U3": "368", "U4": "014578", "U5": "1245678", "U6": "235678"}


@pytest.fixture(scope="module")
def model(spark):
    table = lambda d: spark.createDataFrame([*d.items()], "id string, features array<float>").cache()
    known = spark.createDataFrame([(u, f"I{i}") for u, s in KNOWN.items() for i in s], "user string, item string").cache()
    return table(X), table(Y), known


def rows(df):
    return [(r["item"], r["value"]) for r in df.orderBy(F.desc("value"), "item").collect()]


def only(users, *ids):
    return users.where(F.col("id").isin(*ids))


def test_recommend(model):
    x, y, known = model
    got = rows(serving.recommend(only(x, "U0"), y, known))
    assert len(got) == 6 and got[0] == ("I1", pytest.approx(0.4653969))
    got = rows(serving.recommend(only(x, "U4"), y, known))
    assert len(got) == 3 and got[0] == ("I2", pytest.approx(0.14134796))
    got = rows(serving.recommend(only(x, "U4"), y))
    assert len(got) == 9 and got[0] == ("I7", pytest.approx(2.0047457))
    assert [len(rows(serving.recommend(only(x, "U5"), y, known, n))) for n in (10, 2, 1)] == [2, 2, 1]
    assert [len(rows(serving.recommend(only(x, "U6"), y, known, n, o))) for n, o in ((2, 1), (3, 1), (1, 1), (3, 3))] == [2, 2, 1, 0]
    for n, o in ((-1, 0), (100_001, 0), (1, -1), (50_001, 50_000)):
        with pytest.raises(serving.BadRequestError):
            serving.recommend(x, y, known, n, o)


@pytest.mark.parametrize("ship", [serving.SHIP_BYTES, 0])
def test_hashes_look_at_near_buckets_only(spark, monkeypatch, ship):
    monkeypatch.setattr(serving, "SHIP_BYTES", ship)
    rng = np.random.default_rng(5)
    users, items = rng.standard_normal((30, 8)), rng.standard_normal((400, 8))
    items[200:300] = items[200]  # a bucket that holds a quarter of the items, and ties
    table = lambda m: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, features array<double>")
    planes = lsh.hyperplanes(6, 8)
    signs = lambda m: m @ planes.T > 0
    got = {}
    for r in serving.recommend(table(users), table(items), None, 5, hashes=lsh.Hashes(planes, 1)).collect():
        got.setdefault(r.user, []).append((r["item"], round(r.value, 6)))
    for u in range(len(users)):
        near = np.flatnonzero((signs(users[u : u + 1]) != signs(items)).sum(1) <= 1)
        best = sorted(near, key=lambda i: (-round(float(items[i] @ users[u]), 9), i))[:5]
        assert sorted(got.get(u, [])) == sorted((int(i), round(float(items[i] @ users[u]), 6)) for i in best)


def test_hashes_for_a_rate():
    h = lsh.Hashes.for_rate(0.3, 20, 8)
    assert (len(h.planes), h.bits) == lsh.choose(0.3, 8) and len(h.masks) <= 0.3 * 2 ** len(h.planes)
    assert lsh.Hashes.for_rate(1.0, 20, 1).masks == [0]


def test_blocks_give_the_same(model, monkeypatch):
    x, y, known = model
    want = sorted((r.user, r["item"], round(r.value, 9)) for r in serving.recommend(x, y, known, 4).collect())
    monkeypatch.setattr(serving, "SHIP_BYTES", 0)
    got = sorted((r.user, r["item"], round(r.value, 9)) for r in serving.recommend(x, y, known, 4).collect())
    assert got == want


def test_rescored(model):
    x, y, known = model
    odd = Rescorer(lambda i, v: v * 2, lambda i: F.substring(i, -1, 1).cast("int") % 2 == 0)
    got = rows(serving.recommend(only(x, "U4"), y, known, rescorer=odd))
    assert got == [("I3", pytest.approx(2 * -0.2599307, abs=1e-6))]
    drop = Rescorer(lambda i, v: F.lit(float("nan")))
    assert rows(serving.recommend(only(x, "U4"), y, known, rescorer=combined(odd, drop))) == []
    assert combined(None, None) is None
    both = providers(RescorerProvider(most_popular=lambda args: odd), RescorerProvider())
    assert both.most_popular([]) is odd and both.most_active([]) is None


def test_groups_and_anonymous(spark, model):
    x, y, known = model
    g = spark.createDataFrame([("g", "U0"), ("g", "U2")], "group string, user string")
    got = rows(serving.recommend_to_group(g, x, y, known))
    assert len(got) == 2 and got[0] == ("I1", pytest.approx(0.34344634))
    path = spark.createDataFrame([("r", 0, "I4", 1.0), ("r", 1, "I5", 2.0), ("none", 0, "Z", 1.0)], "request string, position int, item string, weight double")
    who = foldin.profiles(path, y).withColumnRenamed("request", "id")
    used = path.select(F.col("request").alias("user"), "item")
    got = rows(serving.recommend(who, y, used))
    assert len(got) == 7 and got[0] == ("I7", pytest.approx(0.35964763, abs=1e-6))
    to = spark.createDataFrame([("r", "I7", 0), ("r", "I3", 1)], "user string, item string, position int")
    assert dict(rows(serving.estimate(to, who, y))) == {"I7": pytest.approx(0.3596476, abs=1e-6), "I3": pytest.approx(-0.06707495, abs=1e-6)}


def test_context(spark, model):
    x, y, known = model
    path = spark.createDataFrame([("U0", 0, "I4", 1.0, "U0"), ("U0", 1, "I5", 2.0, "U0")], "request string, position int, item string, weight double, user string")
    who = foldin.profiles(path, y, x).withColumnRenamed("request", "id")
    got = rows(serving.recommend(who, y, known.unionByName(path.select("user", "item"))))
    assert len(got) == 5 and got[0] == ("I1", pytest.approx(0.51607955, abs=1e-6))


def test_similarity(spark, model):
    x, y, known = model
    seeds = spark.createDataFrame([("r", i) for i in ("I0", "I4", "I6")], "request string, item string")
    got = rows(serving.similar_items(seeds, y))
    assert len(got) == 6 and got[1][0] == "I5" and got[2][1] == pytest.approx(0.9125432970065859, abs=1e-6)
    asked = spark.createDataFrame([("I0", "I1", 0), ("I0", "I2", 1), ("I0", "Z", 2)], "to string, item string, position int")
    assert dict(rows(serving.similarity_to_item(asked, y))) == {"I1": pytest.approx(0.9042603), "I2": pytest.approx(-0.26486862), "Z": 0.0}
    asked = spark.createDataFrame([("U0", i, k) for k, i in enumerate(("I0", "I1", "I2", "Z"))], "user string, item string, position int")
    assert dict(rows(serving.estimate(asked, x, y))) == {"I0": pytest.approx(0.38761318), "I1": pytest.approx(0.4653969), "I2": pytest.approx(-0.0801478), "Z": 0.0}


def test_because_and_surprising(spark, model):
    x, y, known = model
    asked = spark.createDataFrame([("U0", "I0")], "user string, target string")
    got = rows(serving.because(asked, known, y))
    assert len(got) == 3 and got[0] == ("I0", pytest.approx(1.0))
    got = serving.most_surprising(only(x, "U0"), known, y).orderBy("value").collect()
    assert len(got) == 3 and (got[0]["item"], got[0].value) == ("I0", pytest.approx(0.38761317555864894))


def test_popular(model):
    x, y, known = model
    counts = lambda k, **o: [r["count"] for r in serving.most_popular(ix.counts(known, k), **o).collect()]
    assert len(counts("item")) == 9 and counts("item")[:2] == [6, 6]
    assert len(counts("user")) == 7 and counts("user")[:2] == [7, 6]
    odd = Rescorer(is_filtered=lambda i: F.substring(i, -1, 1).cast("int") % 2 == 0)
    assert counts("item", rescorer=odd)[:2] == [6, 5] and counts("user", rescorer=odd) == [7, 5, 3]
    top = {r.dim: r["item"] for r in serving.representative_items(y).collect()}
    assert top[0] in ("I0", "I3") and top[1] == "I4"
    assert {r["item"] for r in serving.known_of(only(x, "U1"), known).collect()} == {"I1", "I4", "I5", "I7", "I8"}


def test_fold_in():
    t = foldin.target_estimate_value
    assert (t(1, 0.5), t(-1, 0.5), t(0, 0.5), t(0.5, 1.0), t(-0.5, 0.0), t(7, 0.1, False)) == (0.75, 0.25, None, None, None, 7)
    m = np.array([[1.0, 2.0], [3.0, 0.0], [0.0, 1.0]])
    s, y = solver(m.T @ m), np.array([2.0, 1.0])
    assert foldin.fold_in_value(s, 1.0, None, y) == pytest.approx([0.13043478, 0.097826086])
    assert foldin.fold_in_value(s, 0.5, None, y) == pytest.approx([0.11594203, 0.08695652])
    assert foldin.fold_in_value(s, 1.0, np.array([0.1, 0.1]), y) == pytest.approx([0.16086957, 0.14565217])
    assert foldin.fold_in_value(s, 1.0, None, None) is None


def test_fraction(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id string")
    assert serving.fraction_loaded(ids(), ids()) == 1.0
    assert serving.fraction_loaded(ids("a", "b"), ids()) == 0.0
    assert serving.fraction_loaded(ids("a", "b"), ids("a")) == 0.5
    assert serving.ready(ids("a"), ids("a"))


def test_hashes(spark):
    want = {(1, 1): (0, 0), (0.5, 1): (1, 0), (0.1, 1): (4, 0), (1, 2): (1, 1), (0.75, 3): (2, 1), (0.5, 3): (3, 1), (0.1, 8): (7, 1), (0.01, 8): (11, 1), (0.001, 8): (14, 1), (0.0001, 8): (16, 1), (0.5, 32): (7, 3)}
    assert {k: lsh.choose(*k) for k in want} == want
    near = lsh.candidate_buckets(0b1010101, 7, 3)
    assert len(near) == len(set(near)) == 64 and near[0] == 0b1010101
    planes = lsh.hyperplanes(4, 16)
    assert np.abs(planes @ planes.T - np.eye(4)).max() < 0.2


def test_unknown_word(spark):
    counts = spark.createDataFrame([("a", 2)], "word string, count int")
    assert words.lookup(counts, "a").collect() == [("a", 2)]
    with pytest.raises(serving.NotFoundError):
        words.lookup(counts, "b")
