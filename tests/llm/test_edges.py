"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract, line_dedup, packing, quality, secret_scan, sentence_pieces, simhash, telephony, token_counts, toxicity

pub = pytest.importorskip("public_tokenizers")
BPE, PIECES = pub.path("byte_bpe_50k.json"), pub.path("piece_bpe_32k.model")
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
SECRET = 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" stays here'
TEXTS = [(1, None), (2, ""), (None, "some text without an id"), (3, LONG), (4, "a b c d"), (4, "a b c d"), (5, "a b c d"), (6, " \n\n "), (7, SECRET), (8, "x" * 300_000), (9, "你好世界\n你好世界 again")]
CLASH = ["key", "norm", "band", "root", "node", "fp", "gone", "kept", "spans", "text_key", "pieces", "word", "token", "score", "words", "h", "n", "size", "component_id", "start", "label", "y"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 1), (None, 1, 0), (4, 1, 0), (4, 0, 1), (99, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit([])),
    "quality": lambda d: quality.judge(d, None),
    "simhash": simhash.near_duplicates,
    "tokens": lambda d: token_counts.token_counts(d, BPE),
    "media": telephony.store_payloads,
    "pieces": lambda d: sentence_pieces.encode_documents(d, PIECES),
    "packing": lambda d: packing.pack_documents(d, BPE),
}
STAGES = {"toxic": lambda d: toxicity.without_toxic(d, toxicity.fit([])), "lines": line_dedup.without_repeats, "near": simhash.keep_one}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in rows)
    want = sorted((i if i is not None else -1) for i, _ in TEXTS)
    assert (sorted(set(ids)) if name == "packing" else ids) == (sorted(set(want)) if name == "packing" else want)
    assert OPERATORS[name](docs.limit(0)).collect() == []
    assert OPERATORS[name](docs.limit(0)).columns == out.columns


def test_equal_texts_are_equal(docs):
    for name in ("quality", "tokens", "media", "pieces", "simhash"):
        same = [tuple(r)[1:] for r in OPERATORS[name](docs).where("doc_id in (4, 5)").collect()]
        assert len(same) == 3 and len(set(same)) == 1, name


@pytest.mark.parametrize("name", STAGES)
def test_stages(docs, name):
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert {None, 3, 7, 8, 9} <= kept
    assert kept - {None} <= {i for i, _ in TEXTS}
    assert STAGES[name](docs.limit(0)).collect() == []


def test_line_stage_keeps_what_is_no_repeat(docs):
    got = {(r.doc_id, r.text) for r in line_dedup.without_repeats(docs).collect()}
    assert (1, None) in got and (2, "") in got and (6, " \n\n ") in got and (4, "a b c d") in got and (5, "a b c d") not in got
    assert (9, "你好世界\n你好世界 again") in got


def test_near_stage_keeps_one(docs):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert 5 not in kept and kept.count(4) == 2  # repeated rows of the kept id stay
    assert 1 in kept and 2 not in kept and 6 not in kept  # without words: fingerprint zero, linked


def test_secret_stage(spark, docs):
    model = secret_scan.train(spark)
    out = secret_scan.redact(docs, model)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert {r.doc_id: r.text for r in out.where("doc_id = 7").collect()} == {7: 'the token = "[SECRET]" stays here'}
    assert out.where("text <> '' and doc_id <> 7 and instr(text, '[SECRET]') > 0").count() == 0
    assert secret_scan.redact(docs.limit(0), model).collect() == []
    assert secret_scan.scan(docs.limit(0), model).collect() == []


def test_training_on_odd_labels(docs, labels):
    assert toxicity.train(docs, labels).lexicon.terms == []
    assert toxicity.train(docs, labels.limit(0)).score([]) == 0.0
    assert quality.train(docs, labels.limit(0)) is None
    quality.judge(docs, quality.train(docs, labels)).collect()
    rows = [(r.text, r.y) for r in toxicity.labelled_rows(docs, labels, "toxic", {1: 10, 0: 10}).orderBy("doc_id").collect()]
    assert all(zlib.crc32(b"4") % 4 != 2 for _ in rows)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<" * 1000), (5, "u", "<div>" * 3000 + "deep text" + "</div>" * 10), (6, "u", "<p>a" * 20000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert got[1].text == "" and got[2].text == "" and got[None].text == "x" and got[5].text == "deep text" and got[6].n_chars == 2 * 20000 - 1
    assert html_extract.extract_pages(pages.limit(0)).collect() == []
