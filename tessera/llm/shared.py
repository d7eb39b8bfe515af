"""Tables in the folder that the whole cluster shares, and distributed union-find over links."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder, but only for a local master, as in tests; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Makes Spark delete a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TIDYING, _LOCK = {"users": 0, "before": None}, threading.Lock()


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """The setting holds while any thread writes a table, and is then what it was."""
    with _LOCK:
        if not _TIDYING["users"]:
            _TIDYING["before"] = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _TIDYING["users"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _TIDYING["users"] -= 1
            if not _TIDYING["users"]:
                if _TIDYING["before"] is None:
                    spark.conf.unset(_CLEAN)
                else:
                    spark.conf.set(_CLEAN, _TIDYING["before"])


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: its lineage ends, and lost executors lose nothing.

    What isn't dropped before goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of one computation, dropped together when its ``with`` block ends, by an error or not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names, self.of = spark, [], [], {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = shared_table(df, name)
        self.paths.append(path)
        self.of[id(out)] = out, path  # kept, so that the number stays its own
        return out

    def drop(self, table: DataFrame) -> None:
        """Before the others, if ``table`` made it."""
        if made := self.of.pop(id(table), None):
            drop_shared(self.spark, made[1])

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """In buckets of ``key``, so that joins and groups on it don't move it."""
        name = f"tessera_{name}_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/tables/{name}"
        self.paths.append(path)
        self.names.append(name)
        with _tidy(self.spark):
            df.write.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            drop_shared(self.spark, path)


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a table that ``shared_table`` wrote and nothing reads any more."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def components(links: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of undirected links (a, b): rows (node, root), root the smallest node, for all but roots.

    Distributed union-find by alternating stars: each round hangs the larger neighbours of a node, then the
    smaller ones, below their minimum.  Minima are partial aggregates and go back by a join, so a node with very
    many links is never gathered.  Rounds end when the links no longer change.
    """
    spark = links.sparkSession
    stars, path = shared_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    mark = _mark(stars)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = stars.union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Each node's smaller neighbours: large has a < b.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        after, after_path = shared_table(small, "links")
        now = _mark(after)
        drop_shared(spark, path)
        stars, path = after, after_path
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if scratch is not None:
        scratch.paths.append(path)
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _mark(stars: DataFrame) -> tuple[int, int]:
    row = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x or 0


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
