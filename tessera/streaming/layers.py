"""Batch and speed layers as Structured Streaming queries, and the contracts of applications.

A batch generation is: past data is read, the application updates its model, the batch is stored, old data goes.
It runs in one ``foreachBatch``; offsets and recovery are the checkpoint's.  Storing is idempotent, so a batch that
runs again after a failure replaces what it had stored.
"""

from __future__ import annotations

import importlib
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.search import best_candidate, grid, random_search
from tessera.sources.store import delete_old, past, save_generation

LOG_SCHEMA = "key string, value string"


class BatchApp(Protocol):
    def run_update(self, spark: SparkSession, stamp_ms: int, new: DataFrame, old: DataFrame) -> None: ...


class SpeedApp(Protocol):
    def consume(self, updates: DataFrame) -> None: ...

    def build_updates(self, new: DataFrame) -> DataFrame: ...


class ServingApp(Protocol):
    read_only: bool

    def consume(self, updates: DataFrame) -> None: ...

    def model(self) -> object: ...


class LearningApp(ABC):
    """A batch application that searches hyper-parameters: subclasses build, evaluate and publish."""

    test_fraction = 0.1
    candidates = 1
    parallelism = 1
    threshold: float | None = None
    search = "grid"
    seed = 1

    @property
    def domains(self) -> list:
        return []

    @abstractmethod
    def build_model(self, train: DataFrame, params: tuple) -> object: ...

    @abstractmethod
    def evaluate(self, model: object, train: DataFrame, test: DataFrame) -> float: ...

    def publish(self, model: object, new: DataFrame, old: DataFrame, stamp_ms: int) -> None:
        """Called with the best model."""

    def split(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(train, test) of the new data; past data always trains."""
        if self.test_fraction <= 0:
            return new, new.limit(0)
        if self.test_fraction >= 1:
            return new.limit(0), new
        train, test = new.randomSplit([1 - self.test_fraction, self.test_fraction], self.seed)
        return train, test

    def run_update(self, spark: SparkSession, stamp_ms: int, new: DataFrame, old: DataFrame) -> object | None:
        new = new.persist()
        try:
            train, test = self.split(new)
            train = train.unionByName(old.select(new.columns))
            tested = self.test_fraction > 0
            n = self.candidates if tested else 1
            combos = (grid if self.search == "grid" else random_search)(self.domains, n, self.seed)
            best = best_candidate(combos, lambda p: self.build_model(train, p), (lambda m: self.evaluate(m, train, test)) if tested else None, parallelism=self.parallelism, threshold=self.threshold)
            if best is not None:
                self.publish(best.model, new, old, stamp_ms)
            return best
        finally:
            new.unpersist()


def load(dotted: str) -> type:
    """The class of a dotted path."""
    module, _, name = dotted.rpartition(".")
    return getattr(importlib.import_module(module), name)


def generation(app: BatchApp, batch: DataFrame, folder: str, stamp_ms: int, schema: str = LOG_SCHEMA, max_age_hours: int = -1) -> bool:
    """One batch generation; nothing happens for an empty batch."""
    if batch.isEmpty():
        return False
    spark = batch.sparkSession
    app.run_update(spark, stamp_ms, batch, past(spark, folder, schema).drop("generation"))
    save_generation(batch, folder, stamp_ms)
    delete_old(spark, folder, max_age_hours)
    return True


def batch_layer(source: DataFrame, app: BatchApp, folder: str, checkpoint: str, *, schema: str = LOG_SCHEMA, interval_s: int | None = None, max_age_hours: int = -1) -> StreamingQuery:
    """Start it; without an interval it takes what there is and ends.

    A generation is named by its batch number where the clock would not tell a rerun from a new one.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        generation(app, batch, folder, int(time.time() * 1000) if interval_s else epoch + 1, schema, max_age_hours)

    return _start(source, run, checkpoint, interval_s)


def speed_layer(source: DataFrame, app: SpeedApp, publish: Callable[[DataFrame, int], None], checkpoint: str, *, interval_s: int | None = None) -> StreamingQuery:
    """Each micro-batch's updates are built and published; ``publish`` gets them and the batch's number.

    Numbers of messages aren't made of the batch's: ``updates.publish`` puts them after all that the log has.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            publish(app.build_updates(batch), epoch)

    return _start(source, run, checkpoint, interval_s)


def _start(source: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, interval_s: int | None) -> StreamingQuery:
    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{interval_s} seconds") if interval_s else writer.trigger(availableNow=True)).start()


def log_source(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A folder of files as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def topic_source(spark: SparkSession, servers: str, topic: str, from_start: bool = False) -> DataFrame:
    """A broker's topic as (key, value); needs the connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest" if from_start else "latest")
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def topic_sink(rows: DataFrame, servers: str, topic: str) -> None:
    """A batch of (key, value) to a broker's topic."""
    rows.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
