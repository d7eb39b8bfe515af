"""SimHash near-duplicates: fingerprints, deletion-variant index, verification, components.

Two fingerprints that differ in at most 3 bits, cut into two halves, have a half that differs in at most one bit.
So each distinct fingerprint is indexed, for each half, by

* the half with one bit left out (a wildcard), for every bit: an equality join of those that have 0 there with
  those that have 1 there meets exactly the halves that differ in that bit.  The other halves then differ in at most
  two bits, so of three segments of them one is equal: wildcards that very many fingerprints share are also dealt
  by these segments;
* the whole half together with each byte of the other half: of 4 bytes with at most 3 differing bits one is equal,
  which also splits a half that very many fingerprints share.

Candidates are verified on all 64 bits.  Copies share one fingerprint and are indexed once, so a group of copies
of any size costs one index entry; no cap is set anywhere.  A fingerprint has at most 43,744 others within 3 bits,
whatever the number of documents, so links stay in proportion to distinct fingerprints.

Null and empty texts have fingerprint zero and link like any other.  Texts of any length are read whole.  Repeated rows are repeated in the result; a
null doc_id keeps its row and never names a component unless its component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.docmap import map_documents, utf8_list
from tessera.llm.line_dedup import SLOTS
from tessera.llm.shared import Scratch, bits_apart, components, shared_table
from tessera.llm.simhash_bits import fingerprint

HALF = 32
LOW = (1 << HALF) - 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [f - (1 << 64) if (f := fingerprint(t)) >> 63 else f for t in utf8_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return map_documents(docs, run, "doc_id long, fp long")


def _dealt(wild: DataFrame, total: int, least: int = 1000) -> DataFrame:
    """``wild`` with ``part``: -1, or for keys that may be shared by many one row for each segment of the other half.

    Keys are counted by slots, as bands of lines are; at most ``SLOTS`` counts come to the driver and go to the tasks.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int")
    most = 3 * total // SLOTS + least
    hot = wild.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("slot").collect()
    if not hot:
        return wild.select("fp", "key", "side", F.lit(-1).alias("part"))
    marks = F.broadcast(wild.sparkSession.createDataFrame([(r.slot, True) for r in hot], "slot int, hot boolean"))
    other = F.when(F.col("half") == 0, F.col("fp").bitwiseAND(LOW)).otherwise(F.shiftrightunsigned("fp", HALF))
    segments = F.array(*[(F.lit(k << 11).bitwiseOR(F.shiftright(other, 11 * k).bitwiseAND(F.lit((1 << 11) - 1)))).cast("int") for k in range(3)])
    return wild.withColumn("slot", slot).join(marks, "slot", "left").select("fp", "key", "side", F.explode(F.when(F.col("hot"), segments).otherwise(F.array(F.lit(-1)))).alias("part"))


def close_pairs(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` with at most ``most`` (up to 3) differing bits; each once or more."""
    if not 0 <= most <= 3:
        raise ValueError("two halves and one wildcard find up to 3 differing bits")
    own = F.when(F.col("half") == 0, F.shiftrightunsigned("fp", HALF)).otherwise(F.col("fp").bitwiseAND(LOW))
    other = F.when(F.col("half") == 0, F.col("fp").bitwiseAND(LOW)).otherwise(F.shiftrightunsigned("fp", HALF))
    halves = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).select("fp", "half", own.alias("own"), other.alias("other"))
    wild = halves.select("fp", "own", F.col("half"), F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("bit")).select(
        "fp",
        "half",
        # half, bit and the half without that bit: 1 + 5 + 32 bits
        F.expr(f"(cast(half as bigint) << {HALF + 5}) | (cast(bit as bigint) << {HALF}) | (own & ~(1L << bit))").alias("key"),
        F.expr("(own >> bit) & 1L").alias("side"),
    )
    wild = _dealt(wild, 2 * HALF * distinct.count())
    zero, one = wild.where("side = 0").select(F.col("fp").alias("a"), "key", "part"), wild.where("side = 1").select(F.col("fp").alias("b"), "key", "part")
    # Both joins are by merging: the planner takes an exploded side for as small as the table it comes from, and would send it to the driver.
    near = zero.join(one.hint("merge"), ["key", "part"]).where(bits_apart(F.col("a"), F.col("b")) <= most).select("a", "b")
    same = halves.select("fp", F.explode(F.expr("array(0, 1, 2, 3)")).alias("byte"), "half", "own", "other").select(
        "fp", "own", F.expr("half * 1024 + byte * 256 + cast((other >> (8 * byte)) & 255L as int)").alias("rest")
    )
    twin = same.withColumnRenamed("fp", "twin")
    equal = same.join(twin.hint("merge"), ["own", "rest"]).where((F.col("fp") < F.col("twin")) & (bits_apart(F.col("fp"), F.col("twin")) <= most)).select(F.col("fp").alias("a"), F.col("twin").alias("b"))
    return near.union(equal)


def linked_fingerprints(distinct: DataFrame, most: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of the distinct fingerprints ``fp`` that others are within ``most`` bits of."""
    return components(close_pairs(distinct, most), scratch=scratch)


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of ``most`` bits)."""
    with Scratch(docs.sparkSession) as scratch:
        fps, _ = shared_table(fingerprints(docs), "fingerprints")
        distinct = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        roots = linked_fingerprints(distinct.select("fp"), most, scratch)
        joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        firsts = joined.groupBy("root").agg(F.min("first").alias("component_id"))
        by_fp, _ = shared_table(joined.join(firsts, "root").select("fp", "component_id"), "components")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents without all but one of each component of near copies: the one whose doc_id names it.

    Near copies share ``threshold`` of their ``width``-word shingles: fingerprints over these that link propose them, and
    bands of minima those that lie further apart (``near_copies``); ``near_duplicates`` keeps the query's contract.
    A doc_id that several texts have doesn't tie these: each goes or stays by its own words.  Rows that repeat a kept
    id and text stay; rows with a null doc_id stay.
    """
    from tessera.llm.near_copies import near_copies  # which imports this module

    gone = near_copies(docs, width, threshold).where("not kept").select(F.col("doc_id").alias("_t_id"), F.col("text_key").alias("_t_key")).distinct()
    same = (docs["doc_id"].cast("long") == gone["_t_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["_t_key"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
