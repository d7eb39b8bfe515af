"""The update log: ordered messages (seq, key, value) with keys MODEL, MODEL-REF and UP, and what they amount to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions.parsing import to_json_array

MAX_INLINE = 16 << 20
LOG = "seq long, key string, value string"


def vector_messages(vectors: DataFrame, matrix: str, others: str | None = None) -> DataFrame:
    """key, value: ["X","id",[...],["other",...]]; the last element only where ``others`` has any."""
    short = to_json_array(F.lit(matrix), F.col("id"), F.col("features"))
    if others is None:
        return vectors.select(F.lit("UP").alias("key"), short.alias("value"))
    full = to_json_array(F.lit(matrix), F.col("id"), F.col("features"), F.col(others))
    return vectors.select(F.lit("UP").alias("key"), F.when(F.coalesce(F.size(others), F.lit(0)) > 0, full).otherwise(short).alias("value"))


def cluster_messages(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.lit("UP").alias("key"), to_json_array(F.col("id"), F.col("center"), F.col("count")).alias("value"))


def leaf_messages(updates: DataFrame) -> DataFrame:
    """[tree,"node",{"class":count}] or [tree,"node",mean,count]."""
    if "counts" in updates.columns:
        return updates.select(F.lit("UP").alias("key"), to_json_array(F.col("tree"), F.col("node"), F.col("counts")).alias("value"))
    return updates.select(F.lit("UP").alias("key"), to_json_array(F.col("tree"), F.col("node"), F.col("mean"), F.col("count")).alias("value"))


def word_messages(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit("UP").alias("key"), F.concat_ws(",", "word", F.col("count").cast("string")).alias("value"))


def model_message(document: str, path: str, max_inline: int = MAX_INLINE) -> tuple[str, str]:
    """The model itself if it is small enough, else where it is."""
    return ("MODEL", document) if len(document.encode()) <= max_inline else ("MODEL-REF", path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def next_seq(spark: SparkSession, log_path: str, at_least: int = 0) -> int:
    """A number above all in the log, and not below ``at_least``."""
    files, where = _files(spark, log_path)
    if not files.exists(where):
        return at_least
    last = spark.read.schema(LOG).parquet(log_path).agg(F.max("seq").alias("last")).first().last
    return at_least if last is None else max(at_least, last + 1)


def append(spark: SparkSession, log_path: str, key: str, value: str, at_least: int = 0) -> int:
    """Append one message after all others; its number."""
    seq = next_seq(spark, log_path, at_least)
    spark.createDataFrame([(seq, key, value)], LOG).write.mode("append").parquet(log_path)
    return seq


def publish(messages: DataFrame, log_path: str, at_least: int = 0) -> int:
    """Append (key, value) to the log, after all that it has and in the order of partitions and rows; the first number.

    Numbers have no gaps: messages are written with their partition and place in it, and what earlier partitions hold,
    one row a partition, is added.  So whatever is published later comes later, however the rows are partitioned.
    """
    spark = messages.sparkSession
    first = next_seq(spark, log_path, at_least)
    staging = f"{log_path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id()
    try:
        messages.select(F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("row"), "key", "value").write.parquet(staging)
        staged = spark.read.schema("part long, row long, key string, value string").parquet(staging)
        sizes = staged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        staged.join(F.broadcast(before), "part").select((F.col("before") + F.col("row") + first).alias("seq"), "key", "value").write.mode("append").parquet(log_path)
    finally:
        files, where = _files(spark, staging)
        files.delete(where, True)
    return first


def publish_model(spark: SparkSession, document: str, folder: str, log_path: str, at_least: int = 0, max_inline: int = MAX_INLINE) -> int:
    """Append the model's message; a document too large for one is written to ``folder`` and named by its path."""
    key, value = model_message(document, f"{folder.rstrip('/')}/document", max_inline)
    if key == "MODEL-REF":
        spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").parquet(value)
    return append(spark, log_path, key, value, at_least)


def last_model(log: DataFrame) -> tuple[int, str] | None:
    """(number, document) of the log's last model, read from its place if that is what the message names."""
    last = log.where("key in ('MODEL', 'MODEL-REF')").orderBy(F.desc("seq")).select("seq", "key", "value").first()
    if last is None:
        return None
    return last.seq, log.sparkSession.read.parquet(last.value).first().value if last.key == "MODEL-REF" else last.value


def vectors_of(log: DataFrame) -> DataFrame:
    """seq, matrix, id, features, others of the UP messages of factors."""
    parts = F.from_json("value", "array<string>")
    return log.where("key = 'UP'").select("seq", parts.alias("p")).select("seq", F.get("p", 0).alias("matrix"), F.get("p", 1).alias("id"), F.from_json(F.get("p", 2), "array<float>").alias("features"), F.from_json(F.get("p", 3), "array<string>").alias("others"))


def latest_vectors(log: DataFrame) -> DataFrame:
    """matrix, id, features: the last message of each id."""
    return vectors_of(log).groupBy("matrix", "id").agg(F.max_by("features", "seq").alias("features"))


def retained(vectors: DataFrame, models: DataFrame, listed: DataFrame) -> DataFrame:
    """What is left of a matrix after the last MODEL: (id, features).

    ``vectors``: (seq, id, features); ``models``: (seq); ``listed``: ids of the last model.  Ids stay if the model lists
    them, or if they are recent: first seen since the MODEL before the last; later messages count as they come.
    """
    ends = models.agg(F.max("seq").alias("last"), F.max(F.when(F.lit(True), F.col("seq"))).alias("_")).select("last")
    before = models.join(F.broadcast(ends), F.col("seq") < F.col("last")).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("before"))
    by_id = vectors.groupBy("id").agg(F.min("seq").alias("first"), F.max("seq").alias("latest"), F.max_by("features", "seq").alias("features"))
    marked = by_id.join(listed.select("id", F.lit(True).alias("listed")), "id", "left").crossJoin(F.broadcast(before)).crossJoin(F.broadcast(ends))
    keep = F.col("listed").isNotNull() | (F.col("first") > F.col("before")) | (F.col("latest") > F.coalesce("last", F.lit(-1)))
    return marked.where(keep).select("id", "features")


def known_after(log: DataFrame) -> DataFrame:
    """user, item of the X messages: known items only ever grow."""
    return vectors_of(log).where("matrix = 'X'").select(F.col("id").alias("user"), F.explode("others").alias("item")).distinct()


def latest_clusters(log: DataFrame) -> DataFrame:
    parts = F.from_json("value", "array<string>")
    rows = log.where("key = 'UP'").select("seq", F.get(parts, 0).cast("int").alias("id"), F.from_json(F.get(parts, 1), "array<double>").alias("center"), F.get(parts, 2).cast("long").alias("count"))
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "center", "count")


def latest_words(log: DataFrame) -> DataFrame:
    """word, count after the last model (a JSON map, or where a table of word and count is) and the messages after it."""
    last = log.where("key in ('MODEL', 'MODEL-REF')").orderBy(F.desc("seq")).select("seq", "key", "value").first()
    ups = log.where("key = 'UP'").select("seq", F.regexp_extract("value", "^(.*),([0-9]+)$", 1).alias("word"), F.regexp_extract("value", "^(.*),([0-9]+)$", 2).cast("int").alias("count"))
    if last is None:
        rows = ups
    else:
        if last.key == "MODEL-REF":
            model = log.sparkSession.read.parquet(last.value).select(F.lit(last.seq).alias("seq"), "word", F.col("count").cast("int").alias("count"))
        else:
            model = log.where((F.col("seq") == last.seq) & (F.col("key") == "MODEL")).select("seq", F.explode(F.from_json("value", "map<string,int>")).alias("word", "count"))
        rows = model.unionByName(ups.where(F.col("seq") > last.seq))
    return rows.groupBy("word").agg(F.max_by("count", "seq").alias("count"))
