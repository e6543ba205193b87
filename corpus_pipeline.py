"""From raw documents to training sequences: language, quality, exact and near copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each stage's result below the
shared folder and reads it again. All stages but the last return the columns of documents. The stages share the
workers of one cluster, so they take small batches and hand back what they held.

Defined cases are those of the operators: null, empty and letterless texts go with the first stage; of repeated rows one stays;
rows without an id are kept like others; an empty table ends with no sequences; further columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import exact_dedup, jaccard, language, packing, quality
from hostlens.llm.common import fold, kept, small_batches, table

#: Least probability of the language found.
LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose language stays open."""
    small_batches(spark)
    model = language.train(docs, fold(F.col("doc_id"), 4) != 2)
    found = language.judged(spark, model)(F.col("text"))
    return docs.filter((found["lang_pred"] != language.UNKNOWN) & (found["score"] >= LANGUAGE_SCORE))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on the labelled ones of docs, gives a low score."""
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return docs.filter(quality.judged(spark, model)(F.col("text")) >= quality.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of equal texts."""
    return exact_dedup.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, each a sequence."""
    small_batches(spark)
    return packing.report(packing.pack_documents(docs))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Learned models and tokenizers have no SQL; the tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
