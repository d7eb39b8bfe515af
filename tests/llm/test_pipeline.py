"""The queries and the pipeline on the smallest tables."""

import zlib
from pathlib import Path

import numpy as np
import pytest

pub = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = docs
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0.8 * sizes[0]
    lib = Tokenizer.from_file(pub.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*lib.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in last.collect()}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(ids) and sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    whole = corpus_pipeline.run(spark, SF).collect()  # cut elsewhere, as partitions differ
    assert {r.doc_id for r in whole} == set(ids) and sum(r.length for r in whole) == sum(map(len, ids.values()))


def test_queries(spark):
    from tessera.llm import queries

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, q in queries.queries().items():
        out = q(spark, SF)
        if name in ("op1_toxicity", "op3_quality", "op5_simhash", "op6_token_counts", "op7_media", "op8_sentence_pieces"):
            assert out.count() == n and out.select("doc_id").distinct().count() == n, name
    held = queries.op1_toxicity(spark, SF).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
