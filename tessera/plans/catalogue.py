"""All queries over the standard tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import parsing, vectors
from tessera.operators import als, foldin, forest as rdf, interactions as ix, kmeans, lsh, serving, words
from tessera.operators.rescoring import Rescorer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The time that decay and ingestion take as now.
NOW_MS = 1_735_689_600_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = " ".join(sql.split())
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- inputs


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, strength (null: delete), ts_ms, event_id of the event table."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("strength"),
        ix.epoch_ms(F.col("ts")).alias("ts_ms"),
        "event_id",
    )


LOG = """inter AS (SELECT user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, CASE WHEN event_type <> 'error' THEN value END AS s, (epoch_us(ts) // 1000) AS t, event_id AS e FROM events)"""
PAIRS = (
    LOG
    + """, cut AS (SELECT u, i, max(CASE WHEN s IS NULL THEN struct_pack(t := t, e := e) END) AS c FROM inter GROUP BY u, i),
    pairs AS (SELECT u, i, sum(s) AS s FROM inter JOIN cut USING (u, i) WHERE c IS NULL OR struct_pack(t := t, e := e) > c GROUP BY u, i)"""
)
KNOWN = LOG + """, known AS (SELECT u, i FROM inter GROUP BY u, i HAVING arg_max(CASE WHEN s IS NULL THEN 0 ELSE 1 END, struct_pack(t := t, e := e)) = 1)"""
NV = "nv AS (SELECT count(*) AS n FROM embeddings)"
FACTORS = f"""{NV}, y AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings),
    x AS (SELECT u.id, v.embedding::DOUBLE[] AS f FROM (SELECT DISTINCT user_id AS id FROM events) u JOIN embeddings v ON v.vec_id = (u.id * 7 + 100) % (SELECT n FROM nv))"""
DOT, COS = "list_dot_product(x.f, y.f)", "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.implicit(events_log(spark, sf_dir), ["event_id"])


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.known_items(events_log(spark, sf_dir), ["event_id"])


def item_factors(spark: SparkSession, sf_dir: str, rank: int | None = None) -> DataFrame:
    """Every embedding is an item."""
    return _cut(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")), rank)


def user_factors(spark: SparkSession, sf_dir: str, rank: int | None = None) -> DataFrame:
    """Every user of the events, with the embedding that the user's number leads to."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    return _cut(users.join(vecs, F.col("vec_id") == (F.col("id") * 7 + 100) % vecs.count()).select("id", "features"), rank)


def _cut(factors: DataFrame, rank: int | None) -> DataFrame:
    return factors.withColumn("features", F.slice("features", 1, rank)) if rank else factors


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


# ---------------------------------------------------------------- parsing and ingestion

_LINES = """lines AS (SELECT event_id AS e, user_id AS u, json_extract_string(props, '$.k') AS k, CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS v, CAST((epoch_us(ts) // 1000) AS VARCHAR) AS t, event_type AS ty FROM events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("u"), F.get_json_object("props", "$.k").alias("k"), F.round("value").cast("bigint").cast("string").alias("v"), ix.epoch_ms(F.col("ts")).cast("string").alias("t"), F.col("event_type").alias("ty")
    )


@query("parse_csv", f"WITH {_LINES} SELECT e AS event_id, CAST(u AS VARCHAR) AS t0, k AS t1, CASE WHEN ty = 'error' THEN '' ELSE v END AS t2, t AS t3, CAST(4 AS INTEGER) AS n FROM lines")
def parse_csv(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("value", F.concat_ws(",", "u", "k", F.when(F.col("ty") == "error", F.lit("")).otherwise(F.col("v")), "t"))
    return _four(parsing.parse_lines(lines))


@query("parse_quoted_csv", f"""WITH {_LINES} SELECT e AS event_id, CAST(u AS VARCHAR) AS t0, k || ',"' || ty AS t1, ty || '"x"' AS t2, t AS t3, CAST(4 AS INTEGER) AS n FROM lines""")
def parse_quoted_csv(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("value", F.concat(F.col("u"), F.lit(',"'), F.col("k"), F.lit(',""'), F.col("ty"), F.lit('",'), F.col("ty"), F.lit('\\"x\\",'), F.col("t")))
    return _four(parsing.parse_lines(lines))


@query("parse_json", f"WITH {_LINES} SELECT e AS event_id, CAST(u AS VARCHAR) AS t0, k AS t1, v AS t2, t AS t3, CAST(4 AS INTEGER) AS n FROM lines")
def parse_json(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("value", F.concat(F.lit('["'), F.col("u"), F.lit('","'), F.col("k"), F.lit('",'), F.col("v"), F.lit(","), F.col("t"), F.lit("]")))
    return _four(parsing.parse_lines(lines))


def _four(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", *[F.get("tokens", k).alias(f"t{k}") for k in range(4)], F.size("tokens").alias("n"))


@query(
    "ingest_normalize",
    f"""WITH {_LINES} SELECT e AS event_id, CASE WHEN ty = 'view' THEN CAST(u AS VARCHAR) || ',' || k || ',1,' || {NOW_MS}
    WHEN ty = 'click' THEN NULL WHEN ty = 'error' THEN CAST(u AS VARCHAR) || ',' || k || ',,' || t ELSE CAST(u AS VARCHAR) || ',' || k || ',' || v || '.0,' || t END AS line FROM lines""",
)
def ingest_normalize(spark, sf_dir):
    ty, strength = F.col("ty"), F.when(F.col("ty") == "click", F.lit("NaN")).when(F.col("ty") == "error", F.lit("")).otherwise(F.col("v"))
    tokens = F.when(ty == "view", F.array("u", "k")).otherwise(F.array(F.col("u"), F.col("k"), strength, F.col("t")))
    return _lines(spark, sf_dir).select("event_id", parsing.ingest(tokens, F.lit(NOW_MS)).alias("line"))


# ---------------------------------------------------------------- interactions


@query("interactions_implicit", f"WITH {PAIRS} SELECT u AS user_id, i AS item_id, round(s, 6) AS strength FROM pairs")
def interactions_implicit(spark, sf_dir):
    return pairs(spark, sf_dir).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), _r("strength"))


@query("interactions_explicit", f"WITH {LOG} SELECT u AS user_id, i AS item_id, s AS strength FROM (SELECT u, i, s, row_number() OVER (PARTITION BY u, i ORDER BY t DESC, e DESC) AS rn FROM inter) WHERE rn = 1 AND s IS NOT NULL")
def interactions_explicit(spark, sf_dir):
    return ix.explicit(events_log(spark, sf_dir), ["event_id"]).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), "strength")


@query(
    "interactions_decayed",
    f"""WITH {PAIRS.replace("inter AS (SELECT", "raw AS (SELECT", 1).replace(", cut AS", f", inter AS (SELECT u, i, CASE WHEN t < {NOW_MS} THEN s * pow(0.9, ({NOW_MS} - t) / 86400000.0) ELSE s END AS s, t, e FROM raw), cut AS", 1)}
    SELECT u AS user_id, i AS item_id, round(s, 6) AS strength FROM pairs""",
)
def interactions_decayed(spark, sf_dir):
    rows = ix.aggregated(events_log(spark, sf_dir), is_implicit=True, decay=0.9, now_ms=NOW_MS, tie=["event_id"])
    return rows.select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), _r("strength"))


@query("interactions_log", f"WITH {PAIRS} SELECT u AS user_id, i AS item_id, round(ln(1 + s / 0.5), 6) AS strength FROM pairs")
def interactions_log(spark, sf_dir):
    rows = ix.aggregated(events_log(spark, sf_dir), is_implicit=True, log_epsilon=0.5, tie=["event_id"])
    return rows.select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), _r("strength"))


@query("interactions_threshold", f"WITH {LOG} SELECT u AS user_id, i AS item_id, round(sum(s), 6) AS strength FROM inter WHERE s > 20 GROUP BY u, i")
def interactions_threshold(spark, sf_dir):
    rows = ix.aggregated(events_log(spark, sf_dir), is_implicit=True, zero_threshold=20.0, tie=["event_id"])
    return rows.select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), _r("strength"))


@query("orders_interactions", "SELECT o_custkey AS user_id, l_partkey AS item_id, round(sum(l_quantity), 6) AS strength FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def orders_interactions(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("strength"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), "l_linenumber", "l_orderkey")
    return ix.implicit(rows, ["l_orderkey", "l_linenumber"]).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), _r("strength"))


@query("known_items", f"WITH {KNOWN} SELECT u AS user_id, i AS item_id FROM known")
def known_items(spark, sf_dir):
    return known(spark, sf_dir).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"))


@query("known_items_of_user", f"WITH {KNOWN} SELECT u AS user_id, i AS item_id FROM known")
def known_items_of_user(spark, sf_dir):
    """Asked for every user of the model."""
    return serving.known_of(user_factors(spark, sf_dir), known(spark, sf_dir)).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"))


for _name, _key in (("user_counts", "u"), ("item_counts", "i")):
    query(_name, f"WITH {KNOWN} SELECT {_key} AS id, count(*) AS count FROM known GROUP BY 1")(lambda spark, sf_dir, key={"u": "user", "i": "item"}[_key]: ix.counts(known(spark, sf_dir), key))
for _name, _key in (("most_active_users", "u"), ("most_popular_items", "i")):
    query(_name, f"WITH {KNOWN} SELECT {_key} AS id, count(*) AS count FROM known GROUP BY 1 ORDER BY count DESC, id LIMIT 10")(lambda spark, sf_dir, key={"u": "user", "i": "item"}[_key]: serving.most_popular(ix.counts(known(spark, sf_dir), key)))


@query("most_popular_rescored", f"WITH {KNOWN} SELECT i AS id, count(*) AS count FROM known WHERE i % 2 = 1 GROUP BY 1 ORDER BY count DESC, id LIMIT 10 OFFSET 2")
def most_popular_rescored(spark, sf_dir):
    return serving.most_popular(ix.counts(known(spark, sf_dir), "item"), 10, 2, Rescorer(is_filtered=lambda i: i % 2 == 0))


@query("id_index", "SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS index FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events)")
def id_index(spark, sf_dir):
    return ix.id_index(events_log(spark, sf_dir), "user")


_SPLIT = "WITH inter AS (SELECT user_id AS u, event_id AS e, (epoch_us(ts) // 1000) AS t FROM events), b AS (SELECT CAST(trunc(max(t) - 0.2 * (max(t) - min(t))) AS BIGINT) AS edge FROM inter)"


@query("time_split_counts", f"{_SPLIT} SELECT CASE WHEN t < edge THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM inter, b GROUP BY 1")
def time_split_counts(spark, sf_dir):
    train, test = ix.split_by_time(events_log(spark, sf_dir), 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


for _part, _op in (("train", "<"), ("test", ">=")):
    query(f"{_part}_rows", f"{_SPLIT} SELECT u AS user_id, e AS event_id FROM inter, b WHERE t {_op} edge")(lambda spark, sf_dir, k=("train", "test").index(_part): ix.split_by_time(events_log(spark, sf_dir), 0.2)[k].select(F.col("user").alias("user_id"), "event_id"))


# ---------------------------------------------------------------- factor queries

_TOP = "SELECT user_id, item_id, round(v, 6) AS value FROM (SELECT user_id, item_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, item_id) AS rn FROM s)"
_SCORES = f"s AS (SELECT x.id AS user_id, y.id AS item_id, {DOT} AS v FROM x, y)"
_FRESH = f"s AS (SELECT x.id AS user_id, y.id AS item_id, {DOT} AS v FROM x, y WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.u = x.id AND k.i = y.id))"


def _named(rows: DataFrame, user: str = "user") -> DataFrame:
    return rows.select(F.col(user).alias("user_id"), F.col("item").alias("item_id"), _r("value"))


@query("recommend_topk", f"WITH {KNOWN}, {FACTORS}, {_FRESH} {_TOP} WHERE rn <= 10")
def recommend_topk(spark, sf_dir):
    return _named(serving.recommend(user_factors(spark, sf_dir), item_factors(spark, sf_dir), known(spark, sf_dir)))


@query("recommend_known_ok", f"WITH {FACTORS}, {_SCORES} {_TOP} WHERE rn <= 10")
def recommend_known_ok(spark, sf_dir):
    return _named(serving.recommend(user_factors(spark, sf_dir), item_factors(spark, sf_dir)))


@query("recommend_offset", f"WITH {KNOWN}, {FACTORS}, {_FRESH} {_TOP} WHERE rn > 3 AND rn <= 8")
def recommend_offset(spark, sf_dir):
    return _named(serving.recommend(user_factors(spark, sf_dir), item_factors(spark, sf_dir), known(spark, sf_dir), 5, 3))


@query("recommend_rescored", f"WITH {KNOWN}, {FACTORS}, s AS (SELECT x.id AS user_id, y.id AS item_id, {DOT} * CASE WHEN y.id % 5 = 0 THEN 2 ELSE 1 END AS v FROM x, y WHERE y.id % 2 = 1 AND y.id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.u = x.id AND k.i = y.id)) {_TOP} WHERE rn <= 10")
def recommend_rescored(spark, sf_dir):
    nan = F.lit(float("nan"))
    on_arrays = lambda i, v: v * np.where(i % 7 == 0, np.nan, np.where(i % 5 == 0, 2.0, 1.0))
    rescorer = Rescorer(lambda i, v: F.when(i % 7 == 0, nan).when(i % 5 == 0, v * 2).otherwise(v), lambda i: i % 2 == 0, on_arrays)
    return _named(serving.recommend(user_factors(spark, sf_dir), item_factors(spark, sf_dir), known(spark, sf_dir), rescorer=rescorer))


@query(
    "recommend_to_many",
    f"""WITH {KNOWN}, {FACTORS}, g AS (SELECT id // 2 AS g, id FROM x),
    m AS (SELECT g, list(v ORDER BY d) AS f FROM (SELECT g, d, avg(v) AS v FROM (SELECT g, unnest(f) AS v, generate_subscripts(f, 1) AS d FROM g JOIN x USING (id)) GROUP BY g, d) GROUP BY g),
    kn AS (SELECT DISTINCT g, i FROM g JOIN known ON u = id),
    s AS (SELECT m.g AS user_id, y.id AS item_id, list_dot_product(m.f, y.f) AS v FROM m, y WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.g = m.g AND kn.i = y.id))
    SELECT user_id AS group_id, item_id, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, item_id) AS rn FROM s) WHERE rn <= 10""",
)
def recommend_to_many(spark, sf_dir):
    users = user_factors(spark, sf_dir)
    groups = users.select(F.floor(F.col("id") / 2).alias("group"), F.col("id").alias("user"))
    rows = serving.recommend_to_group(groups, users, item_factors(spark, sf_dir), known(spark, sf_dir))
    return rows.select(F.col("group").alias("group_id"), F.col("item").alias("item_id"), _r("value"))


# Rank 2, where the inverse has a closed form.
_R2 = f"""{NV}, y AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
    x AS (SELECT u.id, v.embedding[1]::DOUBLE AS a, v.embedding[2]::DOUBLE AS b FROM (SELECT DISTINCT user_id AS id FROM events) u JOIN embeddings v ON v.vec_id = (u.id * 7 + 100) % (SELECT n FROM nv)),
    gy AS (SELECT sum(a * a) AS p, sum(a * b) AS q, sum(b * b) AS r FROM y), iy AS (SELECT r / (p * r - q * q) AS p, -q / (p * r - q * q) AS q, p / (p * r - q * q) AS r FROM gy),
    gx AS (SELECT sum(a * a) AS p, sum(a * b) AS q, sum(b * b) AS r FROM x), ix AS (SELECT r / (p * r - q * q) AS p, -q / (p * r - q * q) AS q, p / (p * r - q * q) AS r FROM gx)"""


def _target(v: str, s: str) -> str:
    return f"CASE WHEN {v} > 0 AND {s} < 1 THEN {s} + {v} / (1 + {v}) * (1 - greatest(0.0, {s})) WHEN {v} < 0 AND {s} > 0 THEN {s} + {v} / ({v} - 1) * (-least(1.0, {s})) END"


def _step(src: str, item: int, weight: float, out: str) -> str:
    """One fold-in of a fixed item into ``src`` (request, a, b)."""
    return f"""{out}_t AS (SELECT z.request, z.a, z.b, y.a AS ya, y.b AS yb, z.a * y.a + z.b * y.b AS sc FROM {src} z, y WHERE y.id = {item}),
    {out}_d AS (SELECT *, coalesce({_target(f"{weight}", "sc")}, sc) - sc AS d FROM {out}_t),
    {out} AS (SELECT request, CAST(CAST(a + (iy.p * ya + iy.q * yb) * d AS FLOAT) AS DOUBLE) AS a, CAST(CAST(b + (iy.q * ya + iy.r * yb) * d AS FLOAT) AS DOUBLE) AS b FROM {out}_d, iy)"""


_FIRST = f"""z0 AS (SELECT 0 AS request, CAST(CAST((iy.p * y.a + iy.q * y.b) * ({_target("1.0", "0.5")}) AS FLOAT) AS DOUBLE) AS a, CAST(CAST((iy.q * y.a + iy.r * y.b) * ({_target("1.0", "0.5")}) AS FLOAT) AS DOUBLE) AS b FROM y, iy WHERE y.id = 4)"""
_ANON = f"{_R2}, {_FIRST}, {_step('z0', 5, 2.0, 'z1')}"


def _path(spark: SparkSession, requests: list[tuple]) -> DataFrame:
    return spark.createDataFrame(requests, "request long, position int, item long, weight double")


def _anonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foldin.profiles(_path(spark, [(0, 0, 4, 1.0), (0, 1, 5, 2.0), (0, 2, 12345678, 3.0), (1, 0, 987654321, 1.0)]), item_factors(spark, sf_dir, 2))


@query("recommend_anonymous_r2", f"WITH {_ANON} SELECT id AS item_id, round(z.a * y.a + z.b * y.b, 5) AS value FROM z1 z, y WHERE id NOT IN (4, 5) ORDER BY z.a * y.a + z.b * y.b DESC, id LIMIT 10")
def recommend_anonymous_r2(spark, sf_dir):
    who = _anonymous(spark, sf_dir).withColumnRenamed("request", "id")
    used = spark.createDataFrame([(0, 4), (0, 5)], "user long, item long")
    return serving.recommend(who, item_factors(spark, sf_dir, 2), used).select(F.col("item").alias("item_id"), _r("value", 5))


@query("estimate_anonymous_r2", f"WITH {_ANON} SELECT id AS item_id, round(z.a * y.a + z.b * y.b, 5) AS value FROM z1 z, y WHERE id IN (1, 2, 3)")
def estimate_anonymous_r2(spark, sf_dir):
    to = spark.createDataFrame([(0, i, i) for i in (1, 2, 3)], "user long, item long, position int")
    return serving.estimate(to, _anonymous(spark, sf_dir).withColumnRenamed("request", "id"), item_factors(spark, sf_dir, 2)).select(F.col("item").alias("item_id"), _r("value", 5))


@query(
    "recommend_context_r2",
    f"""WITH {KNOWN}, {_R2}, z0 AS (SELECT id AS request, a, b FROM x), {_step("z0", 4, 1.0, "z1")}, {_step("z1", 5, 2.0, "z2")},
    s AS (SELECT z.request AS user_id, y.id AS item_id, z.a * y.a + z.b * y.b AS v FROM z2 z, y WHERE y.id NOT IN (4, 5) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.u = z.request AND k.i = y.id))
    SELECT user_id, item_id, round(v, 5) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, item_id) AS rn FROM s) WHERE rn <= 10""",
)
def recommend_context_r2(spark, sf_dir):
    users = user_factors(spark, sf_dir, 2)
    path = users.select(F.col("id").alias("request"), F.col("id").alias("user"), F.explode(F.array(F.struct(F.lit(0).alias("position"), F.lit(4).cast("long").alias("item"), F.lit(1.0).alias("weight")), F.struct(F.lit(1).alias("position"), F.lit(5).cast("long").alias("item"), F.lit(2.0).alias("weight")))).alias("p")).select("request", "user", "p.*")
    who = foldin.profiles(path, item_factors(spark, sf_dir, 2), users).withColumnRenamed("request", "id")
    used = known(spark, sf_dir).unionByName(path.select("user", "item")).distinct()
    return serving.recommend(who, item_factors(spark, sf_dir, 2), used).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), _r("value", 5))


@query(
    "als_foldin_r2",
    f"""WITH {PAIRS}, {_R2}, p AS (SELECT u, i, s AS v, x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb, x.a * y.a + x.b * y.b AS sc FROM pairs JOIN x ON x.id = u JOIN y ON y.id = i),
    d AS (SELECT *, {_target("v", "sc")} - sc AS d FROM p)
    SELECT 'X' AS matrix, u AS id, i AS other, round(CAST(xa + (iy.p * ya + iy.q * yb) * d AS FLOAT)::DOUBLE, 4) AS f0, round(CAST(xb + (iy.q * ya + iy.r * yb) * d AS FLOAT)::DOUBLE, 4) AS f1 FROM d, iy WHERE d IS NOT NULL
    UNION ALL SELECT 'Y', i, u, round(CAST(ya + (ix.p * xa + ix.q * xb) * d AS FLOAT)::DOUBLE, 4), round(CAST(yb + (ix.q * xa + ix.r * xb) * d AS FLOAT)::DOUBLE, 4) FROM d, ix WHERE d IS NOT NULL""",
)
def als_foldin_r2(spark, sf_dir):
    rows = foldin.speed_updates(pairs(spark, sf_dir), user_factors(spark, sf_dir, 2), item_factors(spark, sf_dir, 2))
    return rows.select("matrix", "id", "other", *[F.round(F.get("features", k).cast("double"), 4).alias(f"f{k}") for k in (0, 1)])


_SIM = COS.format(a="t.f", b="y.f")


@query(
    "similarity_topk",
    f"""WITH {FACTORS}, seeds AS (SELECT id AS item, id // 2 AS request FROM y),
    t AS (SELECT request, list(v ORDER BY d) AS f FROM (SELECT request, d, sum(v) AS v FROM (SELECT request, unnest(f) AS v, generate_subscripts(f, 1) AS d FROM seeds JOIN y ON y.id = item) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT t.request, y.id AS item_id, {_SIM} AS v FROM t, y WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.request = t.request AND item = y.id))
    SELECT request, item_id, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY v DESC, item_id) AS rn FROM s) WHERE rn <= 10""",
)
def similarity_topk(spark, sf_dir):
    items = item_factors(spark, sf_dir)
    seeds = items.select(F.floor(F.col("id") / 2).alias("request"), F.col("id").alias("item"))
    return serving.similar_items(seeds, items).select("request", F.col("item").alias("item_id"), _r("value"))


@query("similarity_to_item", f"WITH {FACTORS}, p AS (SELECT id AS to_id, (id * 7 + 3) % ((SELECT n FROM nv) * 5 // 4) AS item_id FROM y) SELECT to_id, item_id, coalesce(round({_SIM}, 6), 0.0) AS value FROM p JOIN y t ON t.id = to_id LEFT JOIN y ON y.id = item_id")
def similarity_to_item(spark, sf_dir):
    items = item_factors(spark, sf_dir)
    asked = items.select(F.col("id").alias("to"), ((F.col("id") * 7 + 3) % (items.count() * 5 // 4)).alias("item"), F.lit(0).alias("position"))
    return serving.similarity_to_item(asked, items).select(F.col("to").alias("to_id"), F.col("item").alias("item_id"), _r("value"))


@query("estimate", f"WITH {FACTORS}, p AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) + CASE WHEN event_type = 'view' THEN 1000 ELSE 0 END AS i FROM events) SELECT u AS user_id, i AS item_id, coalesce(round({DOT}, 6), 0.0) AS value FROM p JOIN x ON x.id = u LEFT JOIN y ON y.id = i")
def estimate(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.get_json_object("props", "$.k").cast("bigint") + F.when(F.col("event_type") == "view", 1000).otherwise(0)).alias("item")).distinct().withColumn("position", F.lit(0))
    return _named(serving.estimate(asked, user_factors(spark, sf_dir), item_factors(spark, sf_dir)))


@query(
    "because",
    f"""WITH {KNOWN}, {FACTORS}, r AS (SELECT id AS u, id * 3 % (SELECT n FROM nv) AS target FROM x), s AS (SELECT r.u AS user_id, r.target AS target_id, y.id AS item_id, {_SIM} AS v FROM r JOIN y t ON t.id = target JOIN known k ON k.u = r.u JOIN y ON y.id = k.i)
    SELECT user_id, target_id, item_id, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target_id ORDER BY v DESC, item_id) AS rn FROM s) WHERE rn <= 5""",
)
def because(spark, sf_dir):
    items = item_factors(spark, sf_dir)
    asked = user_factors(spark, sf_dir).select(F.col("id").alias("user"), (F.col("id") * 3 % items.count()).alias("target"))
    rows = serving.because(asked, known(spark, sf_dir), items, 5)
    return rows.select(F.col("user").alias("user_id"), F.col("target").alias("target_id"), F.col("item").alias("item_id"), _r("value"))


@query("most_surprising", f"WITH {KNOWN}, {FACTORS}, s AS (SELECT x.id AS user_id, y.id AS item_id, {DOT} AS v FROM x JOIN known k ON k.u = x.id JOIN y ON y.id = k.i) SELECT user_id, item_id, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v, item_id) AS rn FROM s) WHERE rn <= 5")
def most_surprising(spark, sf_dir):
    return _named(serving.most_surprising(user_factors(spark, sf_dir), known(spark, sf_dir), item_factors(spark, sf_dir), 5))


@query("representative_items", f"WITH {FACTORS}, e AS (SELECT id, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS d FROM y) SELECT CAST(d AS INTEGER) AS dim, arg_max(id, struct_pack(v := v, k := -id)) AS item FROM e GROUP BY d")
def representative_items(spark, sf_dir):
    return serving.representative_items(item_factors(spark, sf_dir))


@query("all_user_ids", f"WITH {FACTORS} SELECT id FROM x")
def all_user_ids(spark, sf_dir):
    return user_factors(spark, sf_dir).select("id")


@query("all_item_ids", f"WITH {FACTORS} SELECT id FROM y")
def all_item_ids(spark, sf_dir):
    return item_factors(spark, sf_dir).select("id")


@query("gramian", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, round(sum(a.v * b.v), 6) AS value FROM e a JOIN e b USING (vec_id) WHERE a.d >= b.d GROUP BY 1, 2")
def gramian(spark, sf_dir):
    return vectors.gramian(table(spark, sf_dir, "embeddings"), "embedding").select("i", "j", _r("value"))


@query("vector_norms", "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return serving.unit_norms(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))).select("id", _r("norm"))


@query("target_qui", f"WITH q AS (SELECT event_id, (value - 50) / 10 AS v, (event_id % 31 - 10) / 10.0 AS c FROM events) SELECT event_id, round({_target('v', 'c')}, 6) AS target FROM q")
def target_qui(spark, sf_dir):
    v, c = (F.col("value") - 50) / 10, (F.col("event_id") % 31 - 10) / 10.0
    return table(spark, sf_dir, "events").select("event_id", F.round(foldin.target_estimate(v, c), 6).alias("target"))


@query("als_rmse", f"WITH {PAIRS}, {FACTORS} SELECT round(sqrt(avg(power({DOT} - s, 2))), 6) AS rmse FROM pairs JOIN x ON x.id = u JOIN y ON y.id = i")
def als_rmse(spark, sf_dir):
    return als.rmse(pairs(spark, sf_dir), user_factors(spark, sf_dir), item_factors(spark, sf_dir)).select(_r("rmse"))


@query(
    "als_auc",
    f"""WITH {PAIRS}, {FACTORS}, s AS (SELECT x.id AS u, y.id AS i, {DOT} AS v, EXISTS (SELECT 1 FROM pairs p WHERE p.u = x.id AND p.i = y.id) AS pos FROM x, y WHERE y.id IN (SELECT i FROM pairs) AND x.id IN (SELECT u FROM pairs)),
    a AS (SELECT p.u, avg(CASE WHEN p.v > n.v THEN 1.0 ELSE 0.0 END) AS auc FROM s p JOIN s n ON p.u = n.u WHERE p.pos AND NOT n.pos GROUP BY p.u) SELECT round(avg(auc), 6) AS auc FROM a""",
)
def als_auc(spark, sf_dir):
    return als.area_under_curve(pairs(spark, sf_dir), user_factors(spark, sf_dir), item_factors(spark, sf_dir), sample=False).select(_r("auc"))


# ---------------------------------------------------------------- hashes

_PLANES = [[1.0 if k == i else -1.0 if k == i + 8 else 0.0 for k in range(64)] for i in range(6)]
_BUCKET = " + ".join(f"CASE WHEN embedding[{i + 1}]::DOUBLE - embedding[{i + 9}]::DOUBLE > 0 THEN {1 << i} ELSE 0 END" for i in range(6))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), lsh.bucket(F.col("embedding"), _PLANES).alias("bucket"))


@query("lsh_buckets", f"SELECT vec_id AS id, CAST({_BUCKET} AS INTEGER) AS bucket FROM embeddings")
def lsh_buckets(spark, sf_dir):
    return _hashed(spark, sf_dir).select("id", "bucket")


@query(
    "lsh_candidates_topk",
    f"""WITH h AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, {_BUCKET} AS b FROM embeddings), q AS (SELECT * FROM h WHERE id % 100 = 0),
    s AS (SELECT q.id AS query_id, h.id AS item_id, list_dot_product(q.f, h.f) AS v FROM q JOIN h ON bit_count(xor(q.b, h.b)) <= 1 AND q.id <> h.id)
    SELECT query_id, item_id, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, item_id) AS rn FROM s) WHERE rn <= 5""",
)
def lsh_candidates_topk(spark, sf_dir):
    rows = _hashed(spark, sf_dir)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("features").alias("q"), F.explode(F.transform(F.array(*[F.lit(m) for m in lsh.candidate_buckets(0, 6, 1)]), lambda m: m.bitwiseXOR(F.col("bucket")))).alias("bucket"))
    met = asked.join(rows, "bucket").where("query_id <> id").select("query_id", F.col("id").alias("item"), vectors.dot(F.col("q"), F.col("features")).alias("value"))
    return serving.page(met, F.desc("value"), "item", 5, 0, ["query_id"]).select("query_id", F.col("item").alias("item_id"), _r("value"))


@query(
    "recommend_hashed_topk",
    f"""WITH {KNOWN}, {NV}, y AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, {_BUCKET} AS b FROM embeddings), x AS (SELECT u.id, y.f, y.b FROM (SELECT DISTINCT user_id AS id FROM events) u JOIN y ON y.id = (u.id * 7 + 100) % (SELECT n FROM nv)),
    s AS (SELECT x.id AS user_id, y.id AS item_id, {DOT} AS v FROM x JOIN y ON bit_count(xor(x.b, y.b)) <= 1 WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.u = x.id AND k.i = y.id)) {_TOP} WHERE rn <= 10""",
)
def recommend_hashed_topk(spark, sf_dir):
    return _named(serving.recommend(user_factors(spark, sf_dir), item_factors(spark, sf_dir), known(spark, sf_dir), hashes=lsh.Hashes(_PLANES, 1)))


# ---------------------------------------------------------------- clusters

_CENTERS = """c AS (SELECT label AS id, list(m ORDER BY d) AS f, max(n) AS n FROM (SELECT label, d, avg(v) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    a AS (SELECT vec_id, embedding::DOUBLE[] AS f, min(struct_pack(d := list_distance(embedding::DOUBLE[], c.f), id := c.id)) AS m FROM embeddings, c GROUP BY vec_id, embedding), asg AS (SELECT vec_id, f, m.id AS id, m.d AS d FROM a)"""
_SCATTER = f"{_CENTERS}, sc AS (SELECT c.id, c.f, coalesce(avg(asg.d), 0) AS s FROM c LEFT JOIN asg USING (id) GROUP BY c.id, c.f)"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.col("embedding").cast("array<double>").alias("center"))
    return vectors.mean_vector(e, "center", ["id"]).join(e.groupBy("id").agg(F.count(F.lit(1)).alias("count")), "id")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(_points(spark, sf_dir), _clusters(spark, sf_dir))


@query("kmeans_assign", f"WITH {_CENTERS} SELECT vec_id, CAST(id AS INTEGER) AS cluster_id FROM asg")
def kmeans_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", "cluster_id")


@query("kmeans_distance", f"WITH {_CENTERS} SELECT vec_id, round(d, 6) AS distance FROM asg")
def kmeans_distance(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", _r("distance"))


@query("kmeans_sizes", f"WITH {_CENTERS} SELECT CAST(id AS INTEGER) AS cluster_id, count(*) AS count FROM asg GROUP BY 1")
def kmeans_sizes(spark, sf_dir):
    return kmeans.sizes(_assigned(spark, sf_dir))


@query("kmeans_metrics", f"WITH {_CENTERS} SELECT CAST(id AS INTEGER) AS cluster_id, count(*) AS count, round(sum(d), 6) AS sum_dist, round(sum(d * d), 6) AS sum_sq_dist FROM asg GROUP BY 1")
def kmeans_metrics(spark, sf_dir):
    return kmeans.metrics(_assigned(spark, sf_dir)).select("cluster_id", "count", _r("sum_dist"), _r("sum_sq_dist"))


@query("kmeans_sse", f"WITH {_CENTERS} SELECT round(sum(d * d), 6) AS sse FROM asg")
def kmeans_sse(spark, sf_dir):
    return kmeans.sum_squared_error(_assigned(spark, sf_dir)).select(_r("sse"))


@query("kmeans_davies_bouldin", f"WITH {_SCATTER} SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT p.id, max((p.s + q.s) / list_distance(p.f, q.f)) AS w FROM sc p JOIN sc q ON p.id <> q.id GROUP BY p.id)")
def kmeans_davies_bouldin(spark, sf_dir):
    return kmeans.davies_bouldin(_assigned(spark, sf_dir), _clusters(spark, sf_dir)).select(_r("davies_bouldin"))


@query("kmeans_dunn", f"WITH {_SCATTER} SELECT round((SELECT min(list_distance(p.f, q.f)) FROM sc p JOIN sc q ON p.id <> q.id) / (SELECT max(s) FROM sc), 6) AS dunn")
def kmeans_dunn(spark, sf_dir):
    return kmeans.dunn(_assigned(spark, sf_dir), _clusters(spark, sf_dir)).select(_r("dunn"))


@query(
    "kmeans_silhouette",
    f"""WITH {_CENTERS}, pc AS (SELECT p.vec_id, p.id AS c, q.id AS o, sum(list_distance(p.f, q.f)) AS t, count(*) AS n FROM asg p, asg q GROUP BY 1, 2, 3),
    ab AS (SELECT vec_id, max(CASE WHEN c = o AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN c <> o THEN t / n END) AS b FROM pc GROUP BY 1)
    SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6) AS silhouette FROM ab""",
)
def kmeans_silhouette(spark, sf_dir):
    return kmeans.silhouette(_assigned(spark, sf_dir)).select(_r("silhouette"))


@query(
    "kmeans_speed_update",
    f"""WITH {_CENTERS}, e AS (SELECT id, unnest(f) AS v, generate_subscripts(f, 1) AS d FROM asg), m AS (SELECT id, d, avg(v) AS m, count(*) AS k FROM e GROUP BY 1, 2)
    SELECT CAST(m.id AS INTEGER) AS id, CAST(d - 1 AS INTEGER) AS dim, round(c.f[d] + k / (n + k) * (m - c.f[d]), 6) AS value, n + k AS count FROM m JOIN c ON c.id = m.id""",
)
def kmeans_speed_update(spark, sf_dir):
    rows = kmeans.speed_update(_points(spark, sf_dir), _clusters(spark, sf_dir))
    return rows.select("id", "count", F.posexplode("center").alias("dim", "value")).select("id", "dim", _r("value"), "count")


# ---------------------------------------------------------------- forests


def _classifier() -> rdf.Forest:
    leaf = lambda *c: rdf.Node(class_counts=[float(v) for v in c], count=int(sum(c)))
    one = rdf.Node(feature=0, threshold=25.0, default_positive=True, positive=rdf.Node(feature=4, categories=[1], positive=leaf(10, 80, 10), negative=leaf(45, 20, 40)), negative=leaf(30, 45, 30))
    two = rdf.Node(feature=2, threshold=0.05, positive=leaf(20, 60, 25), negative=rdf.Node(feature=1, threshold=30000.0, default_positive=True, positive=leaf(50, 30, 20), negative=leaf(15, 25, 60)))
    return rdf.Forest([one, two], [1.0, 2.0])


def _regressor() -> rdf.Forest:
    leaf = lambda m, n: rdf.Node(mean=m, count=n)
    one = rdf.Node(feature=0, threshold=25.0, default_positive=True, positive=rdf.Node(feature=4, categories=[1], positive=leaf(52000.5, 10), negative=leaf(51000.25, 20)), negative=leaf(18000.75, 30))
    two = rdf.Node(feature=2, threshold=0.05, positive=leaf(36000.0, 5), negative=leaf(37500.0, 7))
    return rdf.Forest([one, two], [1.0, 2.0])


_ROWS = """r AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS q, l_extendedprice AS p, CASE WHEN l_linenumber <> 6 THEN l_discount END AS d, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS st, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS y, l_extendedprice AS v FROM lineitem),
    l AS (SELECT *, CASE WHEN q IS NULL OR q >= 25 THEN CASE WHEN st = 1 THEN 'r++' ELSE 'r+-' END ELSE 'r-' END AS t0, CASE WHEN d >= 0.05 THEN 'r+' WHEN p IS NULL OR p >= 30000 THEN 'r-+' ELSE 'r--' END AS t1, CASE WHEN d >= 0.05 THEN 'r+' ELSE 'r-' END AS t1r FROM r)"""


def _leaf_sql(name: str, table_: dict[str, float]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table_.items()) + " END"


def _class_sql(y: int) -> str:
    one = {"r++": (10, 80, 10), "r+-": (45, 20, 40), "r-": (30, 45, 30)}
    two = {"r+": (20, 60, 25), "r-+": (50, 30, 20), "r--": (15, 25, 60)}
    share = lambda t: {k: c[y] / sum(c) for k, c in t.items()}
    return f"({_leaf_sql('t0', share(one))} * (1e0 / 3) + {_leaf_sql('t1', share(two))} * (2e0 / 3))"


_DIST = f"{_ROWS}, p AS (SELECT *, {_class_sql(0)} AS p0, {_class_sql(1)} AS p1, {_class_sql(2)} AS p2 FROM l), z AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS c FROM p)"
_REG = f"({_leaf_sql('t0', {'r++': 52000.5, 'r+-': 51000.25, 'r-': 18000.75})} * 1e0 + {_leaf_sql('t1r', {'r+': 36000.0, 'r-': 37500.0})} * 2e0) / 3e0"
_CODES = {"l_linestatus": {"F": 0, "O": 1}, "l_returnflag": {"A": 0, "N": 1, "R": 2}}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda n: F.create_map(*[F.lit(x) for kv in _CODES[n].items() for x in kv])[F.col(n)]
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("f0"), F.col("l_extendedprice").alias("f1"), F.when(F.col("l_linenumber") != 6, F.col("l_discount")).alias("f2"), F.col("l_tax").alias("f3"), code("l_linestatus").alias("f4"), code("l_returnflag").alias("y"))


FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def _features() -> list:
    return [F.col(f) for f in FEATURES]


@query("forest_predict", f"WITH {_DIST} SELECT k AS l_orderkey, n AS l_linenumber, CAST(c AS INTEGER) AS predicted FROM z")
def forest_predict(spark, sf_dir):
    return _rows(spark, sf_dir).select("l_orderkey", "l_linenumber", rdf.classify(_classifier(), _features()).alias("predicted"))


@query("forest_distribution", f"WITH {_DIST} SELECT k AS l_orderkey, n AS l_linenumber, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM z")
def forest_distribution(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("p", rdf.distribution(_classifier(), _features()))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.get("p", k), 6).alias(f"p{k}") for k in range(3)])


@query("forest_regress", f"WITH {_ROWS} SELECT k AS l_orderkey, n AS l_linenumber, round({_REG}, 4) AS predicted FROM l")
def forest_regress(spark, sf_dir):
    return _rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(rdf.regress(_regressor(), _features()), 4).alias("predicted"))


@query("forest_missing_default", f"WITH {_DIST} SELECT k AS l_orderkey, n AS l_linenumber, t0 AS leaf0, t1 AS leaf1 FROM z WHERE q IS NULL OR d IS NULL")
def forest_missing_default(spark, sf_dir):
    f = _classifier()
    return _rows(spark, sf_dir).where("f0 is null or f2 is null").select("l_orderkey", "l_linenumber", *[rdf.leaf_path(t, _features()).alias(f"leaf{k}") for k, t in enumerate(f.trees)])


_VISITS = f"{_ROWS}, v AS (SELECT 0 AS tree, t0 AS leaf FROM l UNION ALL SELECT 1, t1 FROM l), nd AS (SELECT tree, substr(leaf, 1, g) AS node FROM v, (SELECT unnest([1, 2, 3]) AS g) WHERE g <= length(leaf))"


@query("forest_node_counts", f"WITH {_VISITS} SELECT CAST(tree AS INTEGER) AS tree, node, count(*) AS count FROM nd GROUP BY 1, 2")
def forest_node_counts(spark, sf_dir):
    return rdf.node_counts(_rows(spark, sf_dir), _classifier(), _features())


@query(
    "forest_importance",
    f"""WITH {_VISITS}, t AS (SELECT CASE WHEN tree = 0 AND node = 'r' THEN 0 WHEN tree = 0 AND node = 'r+' THEN 4 WHEN tree = 1 AND node = 'r' THEN 2 WHEN tree = 1 AND node = 'r-' THEN 1 END AS f FROM nd), g AS (SELECT f, count(*) AS n FROM t WHERE f IS NOT NULL GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS feature, round(coalesce(n / (SELECT sum(n) FROM g), 0), 6) AS importance FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i) LEFT JOIN g ON f = i""",
)
def forest_importance(spark, sf_dir):
    return rdf.importances(_rows(spark, sf_dir), _classifier(), _features(), 5).select("feature", _r("importance"))


@query("forest_accuracy", f"WITH {_DIST} SELECT round(avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM z")
def forest_accuracy(spark, sf_dir):
    return rdf.accuracy(_rows(spark, sf_dir).withColumn("p", rdf.classify(_classifier(), _features())), "p", "y").select(_r("accuracy"))


@query("forest_rmse", f"WITH {_ROWS} SELECT round(sqrt(avg(power({_REG} - v, 2))), 4) AS rmse FROM l")
def forest_rmse(spark, sf_dir):
    return rdf.rmse(_rows(spark, sf_dir).withColumn("p", rdf.regress(_regressor(), _features())), "p", "f1").select(_r("rmse", 4))


@query("forest_leaf_class_updates", f"WITH {_ROWS}, v AS (SELECT 0 AS tree, t0 AS node, y FROM l UNION ALL SELECT 1, t1, y FROM l) SELECT CAST(tree AS INTEGER) AS tree, node, CAST(y AS INTEGER) AS y, count(*) AS n FROM v WHERE y IS NOT NULL GROUP BY 1, 2, 3")
def forest_leaf_class_updates(spark, sf_dir):
    return rdf.class_updates(_rows(spark, sf_dir), _classifier(), _features(), "y").select("tree", "node", F.explode("counts").alias("y", "n"))


@query("forest_leaf_mean_updates", f"WITH {_ROWS}, v AS (SELECT 0 AS tree, t0 AS node, v FROM l UNION ALL SELECT 1, t1r, v FROM l) SELECT CAST(tree AS INTEGER) AS tree, node, round(avg(v), 4) AS mean, count(*) AS count FROM v GROUP BY 1, 2")
def forest_leaf_mean_updates(spark, sf_dir):
    return rdf.mean_updates(_rows(spark, sf_dir), _regressor(), _features(), "f1").select("tree", "node", _r("mean", 4), "count")


# ---------------------------------------------------------------- words


_PAIRED = "w AS (SELECT list_distinct(string_split(rtrim(line, ' '), ' ')) AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)), a AS (SELECT unnest(w) AS word, w FROM w), p AS (SELECT DISTINCT word, other FROM (SELECT word, unnest(w) AS other FROM a) WHERE word <> other)"


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


@query("word_cooccurrence", f"WITH {_PAIRED} SELECT word, CAST(count(*) AS INTEGER) AS count FROM p GROUP BY 1")
def word_cooccurrence(spark, sf_dir):
    return words.cooccurrence(_text_lines(spark, sf_dir))


_PARTS = "pw AS (SELECT list_distinct(string_split(rtrim(p_name, ' '), ' ')) AS w FROM part), pa AS (SELECT unnest(w) AS word, w FROM pw), pp AS (SELECT DISTINCT word, other FROM (SELECT word, unnest(w) AS other FROM pa) WHERE word <> other), pc AS (SELECT word, count(*) AS c FROM pp GROUP BY 1)"


@query("word_speed_update", f"WITH {_PARTS} SELECT word, CAST(2 * c AS INTEGER) AS count FROM pc")
def word_speed_update(spark, sf_dir):
    """The names of all parts are the model's lines, and come again as a micro-batch."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_name", "value")
    return words.updated(words.cooccurrence(part), part)


# ---------------------------------------------------------------- update log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of the events: each is an update of its item's vector, every 1000th a model."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("k"), F.round("value").alias("v"))
    value = parsing.to_json_array(F.lit("Y"), F.col("k"), F.array(F.col("v"), F.col("v") + 1))
    return e.select("seq", F.when(F.col("seq") % 1000 == 500, "MODEL").otherwise("UP").alias("key"), F.when(F.col("seq") % 1000 == 500, F.lit("{}")).otherwise(value).alias("value"))


_LOG = "lg AS (SELECT event_id AS seq, event_id % 1000 = 500 AS model, json_extract_string(props, '$.k') AS k, round(value) AS v FROM events), up AS (SELECT k AS id, min(seq) AS f, max(seq) AS l, arg_max(v, seq) AS v FROM lg WHERE NOT model GROUP BY 1), ends AS (SELECT max(seq) AS l FROM lg WHERE model), bef AS (SELECT coalesce(max(seq), -1) AS b FROM lg, ends WHERE model AND seq < l)"


@query("update_log_fold", f"WITH {_LOG} SELECT id, v AS f0, v + 1 AS f1 FROM up")
def update_log_fold(spark, sf_dir):
    from tessera.streaming.updates import latest_vectors

    return latest_vectors(_log(spark, sf_dir)).select("id", *[F.get("features", k).cast("double").alias(f"f{k}") for k in (0, 1)])


@query("retain_recent", f"WITH {_LOG} SELECT id, v AS f0 FROM up, ends, bef WHERE CAST(id AS INTEGER) % 3 = 0 OR f > b OR up.l > coalesce(ends.l, -1)")
def retain_recent(spark, sf_dir):
    from tessera.streaming.updates import retained, vectors_of

    log = _log(spark, sf_dir)
    listed = spark.range(0, 100, 3).select(F.col("id").cast("string").alias("id"))
    return retained(vectors_of(log), log.where("key = 'MODEL'").select("seq"), listed).select("id", F.get("features", 0).cast("double").alias("f0"))


@query("fraction_loaded", f"WITH {_LOG}, ex AS (SELECT CAST(i AS VARCHAR) AS id FROM range(0, 130) t(i)) SELECT round((SELECT count(*) FROM up) / ((SELECT count(*) FROM up) + (SELECT count(*) FROM ex WHERE id NOT IN (SELECT id FROM up))), 6) AS fraction")
def fraction_loaded(spark, sf_dir):
    from tessera.streaming.updates import latest_vectors

    there = latest_vectors(_log(spark, sf_dir)).select("id")
    expected = spark.range(130).select(F.col("id").cast("string").alias("id"))
    return spark.createDataFrame([(round(serving.fraction_loaded(expected, there), 6),)], "fraction double")


@query("update_messages", f"""WITH {_LOG} SELECT seq, CASE WHEN model THEN '{{}}' ELSE '["Y","' || k || '",[' || v || ',' || (v + 1) || ']]' END AS value FROM lg""")
def update_messages(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", "value")


@query("update_log_clusters", "SELECT CAST(c AS INTEGER) AS id, s AS count, v AS c0 FROM (SELECT event_id % 7 AS c, event_id AS s, round(value) AS v, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def update_log_clusters(spark, sf_dir):
    from tessera.streaming.updates import cluster_messages, latest_clusters

    e = table(spark, sf_dir, "events").select((F.col("event_id") % 7).cast("int").alias("id"), F.array(F.round("value")).alias("center"), F.col("event_id").alias("count"))
    log = cluster_messages(e).withColumn("seq", F.from_json("value", "array<string>")[2].cast("bigint"))
    return latest_clusters(log).select("id", "count", F.get("center", 0).alias("c0"))


@query("update_log_generations", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS DOUBLE) + 1 AS f0 FROM embeddings")
def update_log_generations(spark, sf_dir):
    """Two generations published over many partitions: the log's last vectors are those of the second."""
    from tessera.streaming import updates as U

    log, e = f"{_scratch(spark)}/log", table(spark, sf_dir, "embeddings").repartition(16, "vec_id")
    for generation in (0, 1):
        rows = e.select(F.col("vec_id").cast("string").alias("id"), F.array(F.col("label") + generation).alias("features"))
        U.publish_model(spark, "{}", f"{log}-model-{generation}", log, generation + 1)
        U.publish(U.vector_messages(rows, "Y"), log)
    return U.latest_vectors(spark.read.schema(U.LOG).parquet(log)).select("id", F.get("features", 0).cast("double").alias("f0"))


@query("als_predict_pairs", f"WITH {PAIRS}, {FACTORS} SELECT u AS user_id, i AS item_id, round({DOT}, 6) AS predicted FROM pairs JOIN x ON x.id = u JOIN y ON y.id = i")
def als_predict_pairs(spark, sf_dir):
    rows = als.predict(pairs(spark, sf_dir), user_factors(spark, sf_dir), item_factors(spark, sf_dir))
    return rows.select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), _r("predicted"))


@query("weighted_means", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_means(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(vectors.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


# ---------------------------------------------------------------- lines in, answers out


@query(
    "categorical_values",
    """SELECT CAST(f AS INTEGER) AS feature, v AS value, CAST(row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT 1 AS f, o_orderstatus AS v FROM orders UNION ALL SELECT DISTINCT 2, o_orderpriority FROM orders)""",
)
def categorical_values(spark, sf_dir):
    from tessera.plans.schema import InputSchema, distinct_values

    schema = InputSchema(feature_names=["o_orderkey", "o_orderstatus", "o_orderpriority"], id_features=["o_orderkey"], numeric_features=[])
    codes = distinct_values(table(spark, sf_dir, "orders"), schema)
    rows = [(f, v, k) for f, values in codes.values.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature int, value string, code int")


def _line_schema():
    from tessera.plans.schema import Encodings, InputSchema

    schema = InputSchema(feature_names=["key", "q", "p", "d", "t", "st", "y"], id_features=["key"], categorical_features=["st", "y"], target_feature="y")
    return schema, Encodings({5: ["F", "O"], 6: ["A", "N", "R"]})


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    q, d = F.when(F.col("l_linenumber") != 7, F.col("l_quantity")), F.when(F.col("l_linenumber") != 6, F.col("l_discount"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", key, text(q), text(F.col("l_extendedprice")), text(d), text(F.col("l_tax")), "l_linestatus", F.lit("")).alias("value"))


@query("predict_lines", f"WITH {_DIST} SELECT k AS l_orderkey, n AS l_linenumber, CASE c WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS prediction FROM z")
def predict_lines(spark, sf_dir):
    from tessera.plans.endpoints import predict_lines as predict

    schema, codes = _line_schema()
    return predict(_order_lines(spark, sf_dir), _classifier(), schema, codes).select("l_orderkey", "l_linenumber", "prediction")


@query("distribution_lines", f"WITH {_DIST} SELECT k AS l_orderkey, n AS l_linenumber, unnest(['A', 'N', 'R']) AS class, unnest([round(p0, 6), round(p1, 6), round(p2, 6)]) AS probability FROM z")
def distribution_lines(spark, sf_dir):
    from tessera.plans.endpoints import distribution_lines as distribution

    schema, codes = _line_schema()
    rows = distribution(_order_lines(spark, sf_dir), _classifier(), schema, codes).select("l_orderkey", "l_linenumber", F.explode("distribution").alias("x"))
    return rows.select("l_orderkey", "l_linenumber", F.col("x.class").alias("class"), F.round("x.probability", 6).alias("probability"))


@query(
    "assign_lines",
    """WITH p AS (SELECT event_id, round(value) AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b FROM events), c AS (SELECT * FROM (VALUES (2, 10.0, 20.0), (3, 100.0, 50.0), (4, 40.0, 80.0)) t(id, x, y)),
    d AS (SELECT event_id, id, sqrt((a - x) * (a - x) + (b - y) * (b - y)) AS d FROM p, c) SELECT event_id, CAST(arg_min(id, struct_pack(d := d, id := id)) AS INTEGER) AS cluster_id, round(min(d), 6) AS distance FROM d GROUP BY 1""",
)
def assign_lines(spark, sf_dir):
    from tessera.plans.endpoints import assign_lines as assign
    from tessera.plans.schema import InputSchema

    schema = InputSchema(feature_names=["id", "a", "b"], id_features=["id"], categorical_features=[])
    clusters = spark.createDataFrame([(2, [10.0, 20.0], 1), (3, [100.0, 50.0], 1), (4, [40.0, 80.0], 1)], "id int, center array<double>, count long")
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.col("event_id").cast("string"), F.round("value").cast("string"), F.get_json_object("props", "$.k")).alias("value"))
    return assign(lines, clusters, schema).select("event_id", "cluster_id", _r("distance"))


# ---------------------------------------------------------------- training, search and streams (rows only)


@query("als_train_topk")
def als_train_topk(spark, sf_dir):
    x, y = als.train(pairs(spark, sf_dir), rank=10, iterations=10)
    seen = known(spark, sf_dir).select(F.col("user").cast("string").alias("user"), F.col("item").cast("string").alias("item"))
    return _named(serving.recommend(x, y, seen))


@query("kmeans_train_sizes")
def kmeans_train_sizes(spark, sf_dir):
    points = _points(spark, sf_dir)
    return kmeans.sizes(kmeans.assign(points, kmeans.train(points, 10)))


@query("forest_train_accuracy")
def forest_train_accuracy(spark, sf_dir):
    rows = _rows(spark, sf_dir).na.fill(0.0, ["f0", "f2"])
    f = rdf.train(rows, FEATURES, "y", classes=3, categories={4: 2}, trees=5, depth=4)
    return rdf.accuracy(rows.withColumn("p", rdf.classify(f, _features())), "p", "y")


@query("forest_train_rmse")
def forest_train_rmse(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 1000).cast("double").alias("key"))
    f = rdf.train(part, ["size", "key"], "price", classes=None, trees=5, depth=5)
    return rdf.rmse(part.withColumn("p", rdf.regress(f, [F.col("size"), F.col("key")])), "p", "price")


@query("hyperparam_grid", "SELECT CAST(r AS INTEGER) AS rank, g AS reg, i AS impurity FROM (SELECT unnest([1, 10]) AS r), (SELECT unnest([0.001e0, 1e0]) AS g), (SELECT unnest(['gini', 'entropy']) AS i)")
def hyperparam_grid(spark, sf_dir):
    from tessera.plans.search import domain, grid

    combos = grid([domain([1, 10]), domain([0.001, 1.0]), domain(["gini", "entropy"])], 8)
    return spark.createDataFrame(combos, "rank int, reg double, impurity string")


@query("hyperparam_best_k")
def hyperparam_best_k(spark, sf_dir):
    from tessera.plans.search import best_candidate, domain, grid

    points = _points(spark, sf_dir).cache()
    best = best_candidate(grid([domain([2, 10])], 3), lambda p: kmeans.train(points, p[0], 10), lambda m: kmeans.evaluate(points, m, "SSE"), parallelism=2)
    points.unpersist()
    return spark.createDataFrame([(best.params[0], best.score)], "k int, score double")


@query("stream_batch_generations", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_batch_generations(spark, sf_dir):
    """The events, as a stream of generations, end in the store whole."""
    from tessera.sources.store import past

    kept = _streamed(spark, sf_dir)
    return past(spark, kept, "event_id long, user_id long, event_type string, value double").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def _scratch(spark: SparkSession) -> str:
    """A new folder that the cluster shares; it goes when the driver's JVM ends."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        shared = tempfile.mkdtemp(prefix="tessera-")
    folder = f"{shared.rstrip('/')}/query-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return folder


class _Nothing:
    def run_update(self, spark, stamp_ms, new, old) -> None:
        """Only stores."""


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    from tessera.streaming.layers import batch_layer

    folder = _scratch(spark)
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").repartition(4, "event_id").write.parquet(f"{folder}/in")
    schema = "event_id long, user_id long, event_type string, value double"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    batch_layer(source, _Nothing(), f"{folder}/data", f"{folder}/checkpoint", schema=schema).awaitTermination()
    return f"{folder}/data"


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows in event time; an extra beside the operators."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", _r("total"))
