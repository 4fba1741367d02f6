"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_exact_dedup, op02_packing, op03_langid, op04_jpeg, op05_bpe, op06_html, op07_substring, op08_token_counts, op09_line_dedup
from . import op10_minhash as op10_minhash_module


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """The driver reads a vocabulary and ships its bytes; executors need no such path."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_packing.pack(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = op03_langid.held_out(F.col("doc_id"))
    model = op03_langid.train(docs.where(~out))
    return op03_langid.predict(docs.withColumn("held_out", out), model, keep=["doc_id", "held_out"])


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_jpeg.payload_digests(op04_jpeg.jpeg_media(table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_html.main_text(table(spark, sf_dir, "pages"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_substring.duplicate_passages(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_minhash_module.near_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_language_id, op4_jpeg, op5_bpe, op6_html, op7_substring, op8_token_counts, op9_line_dedup, op10_minhash)
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_AZ} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
}
