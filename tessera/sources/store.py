"""Generations of data and models as plain tables in a folder, and files of factors."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

_NAME = re.compile(r"^(?:generation=)?(\d+)$")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def generations(spark: SparkSession, folder: str) -> list[int]:
    """Times of the folder's generations, rising."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = (m for s in fs.listStatus(p) if s.isDirectory() and (m := _NAME.match(s.getPath().getName())))
    return sorted(int(m[1]) for m in names)


def save_generation(batch: DataFrame, folder: str, stamp_ms: int) -> bool:
    """Write a micro-batch as one generation; nothing for an empty one.  Running again replaces it."""
    if batch.isEmpty():
        return False
    batch.write.mode("overwrite").parquet(f"{folder}/generation={stamp_ms}")
    return True


def past(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of earlier generations, with their ``generation``; an empty table if there are none."""
    full = f"{schema}, generation long"
    if not generations(spark, folder):
        return spark.createDataFrame([], full)
    return spark.read.option("basePath", folder).schema(full).parquet(f"{folder}/generation=*")


def delete_old(spark: SparkSession, folder: str, max_age_hours: int, now_ms: int | None = None) -> list[int]:
    """Delete generations older than ``max_age_hours``: -1 none, 0 all.  Their times."""
    if max_age_hours < 0:
        return []
    limit = (int(time.time() * 1000) if now_ms is None else now_ms) - max_age_hours * 3_600_000
    gone = [g for g in generations(spark, folder) if max_age_hours == 0 or g < limit]
    for g in gone:
        for name in (f"{folder}/generation={g}", f"{folder}/{g}"):
            fs, p = _fs(spark, name)
            if fs.exists(p):
                fs.delete(p, True)
    return gone


def promote(spark: SparkSession, candidate: str, final: str) -> None:
    """Move the best candidate's folder to its final place, replacing what is there, and drop its siblings."""
    fs, source = _fs(spark, candidate)
    _, target = _fs(spark, final)
    if fs.exists(target):
        fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{candidate} can't be moved to {final}")
    parent = source.getParent()
    if fs.exists(parent) and parent.toString() != target.getParent().toString():
        fs.delete(parent, True)


def write_factors(factors: DataFrame, path: str) -> None:
    """(id, features) as gzip text, one JSON line ["id",[...]] each."""
    line = F.concat(F.lit("["), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(","), F.to_json("features"), F.lit("]"))
    factors.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    parts = F.from_json("value", "array<string>")
    return spark.read.text(path).select(F.get(parts, 0).alias("id"), F.from_json(F.get(parts, 1), "array<float>").alias("features"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files and folders; gzip and bzip2 are read as they are, hidden files are passed over."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the members of zip files; an archive is the unit of work."""
    import io
    import zipfile

    import pandas as pd

    def members(batches):
        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"value": z.read(name).decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "value string")
