"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonepulse.llm.bpe_codec import decode, digests, encode
from zonepulse.llm.catalog_sql import SQL
from zonepulse.llm.common import table
from zonepulse.llm.conversation_repair import damaged, repair
from zonepulse.llm.exact_dedup import exact_dedup
from zonepulse.llm.filter_audit import filter_audit
from zonepulse.llm.html_extract import extract
from zonepulse.llm.near_dedup import near_dedup
from zonepulse.llm.packing import packed_documents
from zonepulse.llm.quality import quality_scores
from zonepulse.llm.substring_dedup import substring_dedup
from zonepulse.llm.suffix_dedup import digests as suffix_digests
from zonepulse.llm.suffix_dedup import suffix_dedup
from zonepulse.llm.token_counts import token_counts
from zonepulse.llm.url_filter import RULES, judge
from zonepulse.llm.vector_search import top_k


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decode(encode(table(spark, sf_dir, "documents"))))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(suffix_dedup(table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_md5", "stays")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, default="allow")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_counts,
        op3_best_fit_packing,
        op4_byte_bpe,
        op5_exact_dedup,
        op6_html_extraction,
        op7_suffix_array_dedup,
        op8_quality_classifier,
        op9_hyperminhash,
        op10_vector_search,
        op11_conversation_repair,
        op12_filter_audit,
        op13_url_filters,
    )
}

__all__ = ["QUERIES", "SQL"]
