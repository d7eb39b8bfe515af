import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing as P


def tokens(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return [r.tokens for r in P.parse_lines(df).orderBy("i").collect()]


def test_lines(spark):
    assert tokens(spark, "a,1,foo", "a,1,foo,", "2.3", "", '["a","1","foo",""]', "[]", "[1,2.5]") == [["a", "1", "foo"], ["a", "1", "foo", ""], ["2.3"], [""], ["a", "1", "foo", ""], [], ["1", "2.5"]]
    assert tokens(spark, 'a,"b,""c",d', 'a\\,b,c', '"x\\"y",z') == [["a", 'b,"c', "d"], ["a,b", "c"], ['x"y', "z"]]
    with pytest.raises(Exception):
        tokens(spark, "[1,]")


def test_ingest(spark):
    rows = [(["a", "B", "1"],), (["c", "B"],), (["c", "D", "5.5"],), (["c", "D", ""],), (["a", "C", "2", "123456789"],), (["a"],), (["a", "b", "aBc!"],), (["a", "b", "NaN"],), (["a", "b", "1", "0"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = [r.x for r in df.select(P.ingest(F.col("t"), F.lit(99)).alias("x")).collect()]
    assert got == ["a,B,1.0,99", "c,B,1,99", "c,D,5.5,99", "c,D,,99", "a,C,2.0,123456789", None, None, None, None]


def test_joining(spark):
    df = spark.createDataFrame([(["a", "b,c", 'd"e', "f\\g"],)], "v array<string>")
    line = df.select(P.join_delimited(F.col("v")).alias("value"))
    assert P.parse_lines(line).first().tokens == ["a", "b,c", 'd"e', "f\\g"]
    pm = df.select(P.join_pmml(F.array(F.lit("a b"), F.lit('c"d'), F.lit("e"))).alias("x")).first().x
    assert pm == '"a b" "c\\"d" e', pm
    assert spark.createDataFrame([(pm,)], "x string").select(P.split_pmml(F.col("x")).alias("t")).first().t == ["a b", 'c"d', "e"]


def test_json_and_paths(spark):
    df = spark.createDataFrame([("i", [1.5, 2.0], ["a", 'b"'])], "id string, f array<float>, o array<string>")
    assert df.select(P.to_json_array(F.lit("X"), F.col("id"), F.col("f"), F.col("o")).alias("x")).first().x == '["X","i",[1.5,2.0],["a","b\\""]]'
    path = spark.createDataFrame([("a=2.5/b/c=1",)], "p string").select(P.item_weights(F.col("p")).alias("w")).first().w
    assert [tuple(w) for w in path] == [("a", 2.5), ("b", 1.0), ("c", 1.0)]
