"""The operators' queries over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import (
    exact_dedup, fill_middle, html_text, jaccard, language, lm_scores, packing, pieces, quality, resampling, token_counts, top_k, url_filter,
)
from hostlens.llm.common import fold, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[function.__name__] = function
    return function


@_query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.train(documents, table(spark, folder, "labels"), ~held_out)
    scored = quality.classify(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


@_query
def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores.score_documents(table(spark, folder, "documents"), fold(F.col("doc_id"), 7) == 2)


@_query
def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, folder, "documents"))


@_query
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.train(documents, ~held_out)
    judged = language.identify(documents, model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@_query
def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"))


@_query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(packing.pack_documents(table(spark, folder, "documents")))


@_query
def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.report(fill_middle.store(table(spark, folder, "documents")))


@_query
def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))
