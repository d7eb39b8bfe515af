import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_dot_norm_cosine(spark):
    x, y = arr(1, 0.5, -3.5), arr(0, -10.3, -3)
    assert one(spark, V.dot(x, y)) == pytest.approx(5.35)
    assert one(spark, V.norm(x)) == pytest.approx(3.674234614174767)
    assert one(spark, V.norm(y)) == pytest.approx(10.72800074571213)
    assert one(spark, V.cosine(x, y)) == pytest.approx(0.13572757431921362)


def test_gramian(spark):
    rows = [[1.3, -2.0, 4.0], [2.0, 0.0, 1.5], [0.0, 3.0, -7.0]]
    df = spark.createDataFrame([(r,) for r in rows], "features array<float>")
    m = np.array(rows, np.float32).astype(float)
    assert V.gramian_matrix(df) == pytest.approx(m.T @ m)
    assert V.gramian_matrix(df.limit(0)).shape == (0, 0)


def test_solver():
    a = np.array([[1.3, -2.0, 3.0], [2.0, 0.0, 5.0], [0.0, -1.5, 5.5]])
    s = V.solver(a.T @ a)
    b = np.array([1.0, 2.0, 6.5])
    assert (a.T @ a) @ s.solve(b) == pytest.approx(b)
    with pytest.raises(V.SingularMatrixError) as e:
        V.solver(np.array([[1.3, -2, 3], [2, 0, 5], [3.3, -2, 8]]) * 1.0)
    assert e.value.rank == 2
    with pytest.raises(V.SingularMatrixError) as e:
        V.solver(np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert e.value.rank == 1


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "k int, v array<double>")
    assert {r.k: r.v for r in V.mean_vector(df, "v", ["k"]).collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    assert {r.k: r.v for r in V.mean_vector(df, "v", ["k"], mean=False).collect()} == {1: [4.0, 8.0], 2: [5.0, 5.0]}
