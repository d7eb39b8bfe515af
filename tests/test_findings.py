"""What a review found in serving and word counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import serving, words
from tessera.operators.rescoring import Rescorer, combined


@pytest.mark.parametrize("ship", [64 << 20, 0])
def test_rescored_pairs_stay_in_their_task(spark, monkeypatch, ship):
    """By rows and by arrays: the same as brute force, and only each user's best leave a task."""
    monkeypatch.setattr(serving, "SHIP_BYTES", ship)
    draw = np.random.default_rng(3)
    y, x = draw.integers(-5, 6, (900, 4)).astype(float), draw.integers(-5, 6, (7, 4)).astype(float)
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "id long, features array<double>")
    users = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>")
    known = spark.createDataFrame([(u, i) for u in range(7) for i in range(u, 900, 41)], "user long, item long")
    by_rows = Rescorer(lambda i, v: F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 5 == 0, v * 2).otherwise(v), lambda i: i % 2 == 0)
    by_arrays = Rescorer(by_rows.rescore, by_rows.is_filtered, lambda i, v: v * np.where(i % 7 == 0, np.nan, np.where(i % 5 == 0, 2.0, 1.0)))
    want = set()
    for u in range(7):
        scores = [(-float(y[i] @ x[u]) * (2 if i % 5 == 0 else 1), i) for i in range(900) if i % 2 and i % 7 and (i - u) % 41]
        want |= {(u, i, -s) for s, i in sorted(scores)[3:8]}
    for rescorer in (by_rows, by_arrays, combined(by_rows, by_arrays, None) and by_arrays):
        got = serving.recommend(users, items, known, 5, 3, rescorer)
        assert {(r.user, r["item"], r.value + 0.0) for r in got.collect()} == want
        scored = serving.top_candidates(users, rescorer.filter_only(items, "id"), None, 8, rescorer=rescorer)
        assert scored.count() <= 7 * 8 * (1 if ship else 4)
    assert combined(by_rows, by_arrays).on_arrays is None and combined(by_arrays, by_arrays).on_arrays is not None


def test_a_task_holds_few_scores_at_once(monkeypatch):
    monkeypatch.setattr(serving, "PAIRS", 100)
    monkeypatch.setattr(serving, "ROWS", 16)
    mine = pd.DataFrame({"user": range(30), "features": [[1.0, float(k)] for k in range(30)], "most": 3})
    ids, matrix = np.arange(40), np.arange(80.0).reshape(40, 2)
    parts = [*serving._scored(mine, matrix)]
    assert sum(len(p) for p, _ in parts) == 30 and max(s.size for _, s in parts) <= 100
    rows = [*serving._every_pair(mine, ids, matrix)]
    assert max(map(len, rows)) <= 16 and len(pd.concat(rows).drop_duplicates(["user", "item"])) == 1200


def _brute(lines):
    sets = [set(x.rstrip(" ").split(" ")) for x in lines]
    out = {}
    for s in sets:
        for w in s:
            out.setdefault(w, set()).update(s - {w})
    return {w: len(o) for w, o in out.items() if o}


def test_partner_counts_by_marks_and_by_sorting(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 50)  # pairs at once
    monkeypatch.setattr(words, "MARKED", 20)
    draw = np.random.default_rng(1)
    for n_a, n_b, n in ((3, 300, 60), (300, 3, 60), (40, 40, 200), (2000, 3000, 100)):
        a = [draw.permutation(n_a)[: draw.integers(0, min(n_a, 9) + 1)] for _ in range(n)]
        b = [draw.permutation(n_b)[: draw.integers(0, min(n_b, 9) + 1)] for _ in range(n)]
        pairs = {(int(x), int(y)) for p, q in zip(a, b, strict=True) for x in p for y in q}
        got = words.partner_counts(np.concatenate(a), np.array([*map(len, a)]), n_a, np.concatenate(b), np.array([*map(len, b)]), n_b)
        assert got[0].tolist() == [sum(x == k for x, _ in pairs) for k in range(n_a)]
        assert got[1].tolist() == [sum(y == k for _, y in pairs) for k in range(n_b)]


def test_pairs_of_words_are_not_shuffled(spark):
    """Long lines of different words: the same as brute force, and no row is a pair."""
    draw = np.random.default_rng(2)
    lines = [" ".join(f"w{k}" for k in draw.zipf(1.3, 200) % 3000) for _ in range(60)] + ["", "  ", "one", "a  b ", "é ü é", "a b", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    out = words.cooccurrence(df)
    assert {r.word: r["count"] for r in out.collect()} == _brute([x for x in lines if x is not None])
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert words.cooccurrence(df.limit(0)).collect() == []
