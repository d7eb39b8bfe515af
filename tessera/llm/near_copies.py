"""Near copies of documents: SimHash components and MinHash bands over word shingles, exact Jaccard, distributed union-find.

Each document's 64-bit SimHash fingerprint over the same shingles is linked as the query of fingerprints links them: by
one-wildcard variants of halves, verified at 3 bits, and union-find.  Documents of one such component are candidates, as
those of a band are.  Three bits hold nearly equal documents; a similarity of 0.8 lies about 10 bits apart, many 15, where
segments of 64 bits are no longer selective.  So documents are also banded by 100 minima: 20 bands of 5 hold 0.9996 of the
pairs with similarity 0.8.  Candidates of both are verified by the exact Jaccard similarity of their sets of shingles, as
lines are.  Documents of equal words share one key and are indexed once.

Words are those of the fingerprints.  Null and empty texts have equal (no) words; a text of fewer words than a shingle
is one shingle.  A null doc_id never names a component unless its component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tessera.llm.docmap import map_documents, utf8_list
from tessera.llm.line_dedup import linked
from tessera.llm.shared import Scratch, shared_table
from tessera.llm.simhash import linked_fingerprints
from tessera.llm.simhash_bits import majority, shingle_hashes

BANDS, ROWS = 20, 5
_CONSTANTS = np.random.default_rng(7).integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashes_of(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles, repeats included; fewer words are one."""
    return shingle_hashes(words, width) if len(words) >= width else np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)


def bands(hashes: np.ndarray, block: int = 1 << 12) -> list[int]:
    """For each band the hash of its minima of hash XOR constant."""
    least = np.full(len(_CONSTANTS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), block):
        least = np.minimum(least, (hashes[k : k + block, None] ^ _CONSTANTS).min(0))
    return [_signed(xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b)) for b in range(BANDS)]


def _key(words: list[bytes]) -> int:
    return _signed(xxh64_intdigest(b" ".join(words)))


def _mapped(docs: DataFrame, width: int, name: str) -> DataFrame:
    """(doc_id, key, text_key, fp, name): the bands, or the whole set as ``all``; ``text_key`` is what xxhash64 gives for the text."""
    made = (lambda h: bands(h)) if name == "bands" else (lambda h: h.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_list(batch.column(1))
            keys, fps, values = [], [], []
            for t in texts:
                words = t.lower().split()
                hashes = hashes_of(words, width)
                keys.append(_key(words))
                fps.append(_signed(majority(hashes)) if words else 0)
                values.append(made(np.unique(hashes)))
            text_keys = pa.array([_signed(xxh64_intdigest(t, 42)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), text_keys, pa.array(fps, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "key", "text_key", "fp", name]
            )

    return map_documents(docs, run, f"doc_id long, key long, text_key long, fp long, {name} array<long>")


def near_copies(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_key, component_id (smallest doc_id reachable over links), kept: one row per row.

    Kept are a component's rows with its id and the words of one row that has it, and all rows without an id.
    """
    with Scratch(docs.sparkSession) as scratch:
        mapped = scratch.table(_mapped(docs, width, "bands"), "mapped")
        distinct = scratch.table(mapped.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
        roots = linked_fingerprints(scratch.table(distinct.select("fp").distinct(), "fingerprints"), scratch=scratch).toDF("fp", "fp_root")
        # A component of fingerprints is one more band of its documents.
        component = F.xxhash64(F.lit("fingerprints"), F.coalesce("fp_root", "fp"))
        banded = distinct.join(roots, "fp", "left").select("key", F.concat("bands", F.array(component)).alias("bands"))

        def sets_of(keys: DataFrame) -> DataFrame:
            # One row of each key: the one whose doc_id comes first, or those without ids.
            wanted = distinct.join(keys, "key", "left_semi").select(F.col("first").alias("_t_first")).distinct()
            rows = docs.join(wanted, docs["doc_id"].cast("long").eqNullSafe(F.col("_t_first")), "left_semi")
            return _mapped(rows, width, "all").select("key", "all").dropDuplicates(["key"])

        nodes = linked(scratch.table(banded, "banded"), sets_of, threshold, scratch)
        joined = distinct.join(nodes, distinct.key == nodes.node, "left").select("key", "first", F.coalesce("root", "key").alias("root"))
        # Nulls come last: they name a component only where there is no other id.
        firsts = joined.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("m"))
        by_key = joined.join(firsts, "root").select("key", F.col("m.first").alias("component_id"), F.col("m.key").alias("component_key"))
        same = (F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("component_key"))
        rows = mapped.select("doc_id", "key", "text_key").join(by_key, "key").select("doc_id", "text_key", "component_id", (F.col("doc_id").isNull() | same).alias("kept"))
        out, _ = shared_table(rows, "copies")
    return out
