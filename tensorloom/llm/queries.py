"""The registered queries of the training-data operators: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm import embed_dedup, html_extract, license_scan, mixing, pii, piece_bpe, quality, simhash, topk, url_filter
from tensorloom.llm.common import table


def tokenizer_file() -> str:
    """The public SentencePiece BPE model of 32,000 pieces; installed on every machine, never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3)


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(), digest=True)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents", "doc_id", "text")))


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_license_scan, op3_topk, op4_simhash, op5_piece_bpe, op6_url_filter, op7_pii, op8_embed_dedup, op9_mixing, op10_html)
}
