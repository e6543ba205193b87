"""Exact duplicate removal by a heavy-hitter split, in DataFrame functions only.

Texts are equal when they agree after every run of white space (space, tab to carriage
return) has become one space; a null text counts as empty. A text is represented by the
SHA-256 of that normal form.

1. Misra-Gries counters (`freqItems`) name every digest that holds more than `support` of all
   rows, among at most 1/support candidates.
2. The candidates' rows are counted and their smallest id is found; partial sums are formed
   before the shuffle. The result is a table of at most 1/support rows, whatever the input.
3. That table is broadcast: rows of frequent digests get their group's figures in place and
   are not shuffled. Only the rows of the kept ids among them are counted, by partial sums, since
   one of them is kept if there are several.
4. The other digests are counted by an ordinary shuffle and joined back. No group of that path
   holds more than `support` of the rows.

Defined cases: an empty table gives an empty table. Rows that agree in id and text are repeated
rows; each gets its own result row and exactly one of them is kept. A null id is larger than any
other id, so such a row stays only in a group without ids. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import SPACES, chosen, kept

#: Share of all rows from which on a digest is handled without a shuffle.
SUPPORT = 0.001


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of every row."""
    normal = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    return chosen(documents, doc_id=F.col("doc_id"), text_sha256=F.sha2(normal.cast("binary"), 256))


def _figures(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )


def deduplicate(documents: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of documents."""
    table = kept(digests(documents), "digests")
    candidates = (
        table.stat.freqItems(["text_sha256"], support)
        .select(F.explode("text_sha256_freqItems").alias("text_sha256"))
        .filter(F.col("text_sha256").isNotNull())
        .distinct()
    )
    # At most 1/support rows of one digest and two numbers: bounded by the parameter.
    of_candidates = table.withColumn("copies", F.lit(1).cast("long")).join(
        F.broadcast(candidates), "text_sha256", "left_semi"
    )
    heavy = kept(_figures(of_candidates), "heavy")
    marked = table.join(
        F.broadcast(heavy.withColumnRenamed("keep_id", "heavy_id").withColumnRenamed("group_size", "heavy_size")),
        "text_sha256",
        "left",
    )
    frequent = marked.filter(F.col("heavy_size").isNotNull()).select(
        "text_sha256", "doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size")
    )
    keeps = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # One row for equal (id, digest) pairs: repeated rows can be told apart only by counting them.
    names = ["text_sha256", "doc_id", "keep_id", "group_size"]
    first = frequent.filter(keeps).groupBy(*names).agg(F.count("*").alias("copies"))
    other = marked.filter(F.col("heavy_size").isNull()).groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    rare = other.join(_figures(other), "text_sha256")
    # The k-th of the repeated rows of the kept id is kept for k = 1 only.
    counted = (
        first.unionByName(rare)
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k"))
        .withColumn("kept", keeps & (F.col("k") == 1))
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return counted.select(columns).unionByName(frequent.filter(~keeps).withColumn("kept", F.lit(False)).select(columns))


def distinct_documents(documents: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of documents that stay, with all their columns.

    Kept (id, digest) pairs are joined back to the rows; where a kept id occurs in repeated rows,
    which may differ in further columns, one of them stays.
    """
    decided = kept(deduplicate(documents, support), "decided")
    stays = decided.filter("kept").select("doc_id", "text_sha256")
    repeated = decided.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1")
    names = documents.columns
    normal = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    whole = documents.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
        F.col("doc_id").alias("id"),
        F.sha2(normal.cast("binary"), 256).alias("digest"),
    )
    same = lambda right: F.col("id").eqNullSafe(right.doc_id) & (F.col("digest") == right.text_sha256)
    remaining = whole.join(stays, same(stays), "left_semi")
    single = remaining.join(repeated, same(repeated), "left_anti")
    several = remaining.join(repeated, same(repeated), "left_semi").dropDuplicates(["id", "digest"])
    return single.unionByName(several).select("row.*")
