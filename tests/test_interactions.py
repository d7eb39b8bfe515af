import math

import pytest

from tessera.operators import als, interactions as ix, words

SCHEMA = "user string, item string, strength double, ts_ms long"


def log(spark, *rows):
    return spark.createDataFrame([*rows], SCHEMA)


def as_dict(df):
    return {(r.user, r.item): r.strength for r in df.collect()}


@pytest.mark.parametrize(("values", "want"), [([1], 1), ([1, 2, 3], 6), ([1, None, 3], 3), ([1, 2, None], None), ([None], None)])
def test_sum_with_reset(spark, values, want):
    rows = log(spark, *[("u", "i", None if v is None else float(v), t) for t, v in enumerate(values)])
    assert as_dict(ix.implicit(rows)) == ({} if want is None else {("u", "i"): want})


def test_explicit_is_last_wins(spark):
    rows = log(spark, ("u", "i", 1.0, 1), ("u", "i", 5.0, 3), ("u", "i", 2.0, 2), ("u", "j", 1.0, 1), ("u", "j", None, 2))
    assert as_dict(ix.explicit(rows)) == {("u", "i"): 5.0}


def test_decay_threshold_log(spark):
    day = 86_400_000
    rows = log(spark, ("u", "i", 3.0, 0), ("u", "j", 3.0, day), ("u", "k", -1.0, day))
    assert as_dict(ix.decayed(rows, 0.5, day)) == {("u", "i"): 1.5, ("u", "j"): 3.0, ("u", "k"): -1.0}
    assert set(as_dict(ix.above(rows, 1.0))) == {("u", "i"), ("u", "j")}
    assert as_dict(ix.log_strength(ix.implicit(rows.where("item = 'i'")), 0.5)) == {("u", "i"): pytest.approx(math.log1p(6))}


def test_known_items_replay_deletes(spark):
    """A 4 x 4 upper triangle, then the diagonal deleted, then one pair added again."""
    n = [f"{chr(65 + k)}{k}" for k in range(4)]
    rows = [(n[u], n[i], 1.0, 10 * u + i) for u in range(4) for i in range(u, 4)]
    rows += [(n[u], n[u], None, 100 + u) for u in range(4)] + [("A0", "A0", 1.0, 200)]
    known = {}
    for r in ix.known_items(log(spark, *rows)).collect():
        known.setdefault(r.user, set()).add(r["item"])
    assert known == {"A0": {"A0", "B1", "C2", "D3"}, "B1": {"C2", "D3"}, "C2": {"D3"}}


def test_id_index_is_dense_and_sorted(spark):
    rows = spark.createDataFrame([(str(k % 700),) for k in range(3000)], "user string")
    got = {r.id: r["index"] for r in ix.id_index(rows, "user").collect()}
    assert got == {v: k for k, v in enumerate(sorted({str(k) for k in range(700)}))}
    assert ix.id_index(rows.limit(0), "user").collect() == []


def test_time_split(spark):
    rows = log(spark, *[("u", "i", 1.0, t) for t in range(11)])
    train, test = ix.split_by_time(rows, 0.3)
    assert (train.count(), test.count()) == (7, 4)
    assert ix.split_by_time(rows, 0)[1].count() == 0
    assert ix.split_by_time(rows, 1)[0].count() == 0


def test_auc_counts_ties_as_wrong(spark):
    x = spark.createDataFrame([("u", [1.0])], "id string, features array<float>")
    y = spark.createDataFrame([("a", [3.0]), ("b", [2.0]), ("c", [2.0]), ("d", [1.0])], "id string, features array<float>")
    test = log(spark, ("u", "a", 1.0, 0), ("u", "c", 1.0, 0), ("v", "b", 1.0, 0), ("v", "d", 1.0, 0))
    assert als.area_under_curve(test, x, y, sample=False).first().auc == pytest.approx((2 + 1) / 4)
    assert 0 <= als.area_under_curve(test, x, y).first().auc <= 1


def test_words(spark):
    lines = spark.createDataFrame([("foo bar baz",)], "value string")
    assert {r.word: r["count"] for r in words.cooccurrence(lines).collect()} == {"foo": 2, "bar": 2, "baz": 2}
    more = spark.createDataFrame([("foo qux ",)], "value string")
    assert {r.word: r["count"] for r in words.updated(words.cooccurrence(lines), more).collect()} == {"foo": 3, "qux": 1}
    the = spark.createDataFrame([("the quicker the better",)], "value string")
    assert {r["count"] for r in words.cooccurrence(the).collect()} == {2}
