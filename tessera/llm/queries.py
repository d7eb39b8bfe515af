"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, threshold=0.3).select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "n_quoted", "n_edited", "terms")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_classes

    return line_classes(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), limit=512)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.telephony import store_payloads

    return store_payloads(_table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentence_pieces import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import secret_scan

    found = secret_scan.scan(_table(spark, sf_dir, "documents"), secret_scan.train(spark))
    return found.select("doc_id", "start", "length", "kind", "score", "is_secret", "token_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality": op3_quality,
        "op4_html": op4_html,
        "op5_simhash": op5_simhash,
        "op6_token_counts": op6_token_counts,
        "op7_media": op7_media,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_secrets": op9_secrets,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {}
