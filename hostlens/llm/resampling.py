"""Importance resampling towards a target corpus, with bit-sliced sums of signed gains.

Features are runs of 1 to `n` consecutive words, dealt into `buckets` by the CRC-32 of their bytes.

1. The bucket counts of all documents and of all target texts are summed: one vector per task, then a shuffle of
   at most `buckets` rows per task. The two vectors, bounded by the parameter, come to the driver, which turns them
   into one whole number per bucket, its gain.
2. Gains become signed bit planes: plane k of each sign holds one bit per bucket. A document's counts become planes
   the same way. A count plane AND a gain plane, counted (popcount) and shifted by both plane numbers, summed over all
   pairs of planes, is exactly the sum of gain times count.
3. Adding a Gumbel draw of the id's digest to the weight makes "the highest scores" a draw without replacement
   in proportion to exp(weight / 1000). Ranks are numbered by range partitions: rows are dealt out by (score, id),
   each partition is numbered by itself and shifted by the sizes of those before it.

Words of a long text are taken a window at a time, so memory does not grow with a text beyond the text itself.

Defined cases: null and empty texts have no features and weight 0. Equal scores go by the smaller id, a null id last; a null
id draws like the empty id. Repeated rows count and rank as rows of their own. An empty document table gives an
empty table; without target texts all their counts are 0. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, cuts, kept, map_batches

N, BUCKETS = 1, 10_000
#: A draw takes this percent of the documents with at least LEAST_WORDS words.
PERCENT, LEAST_WORDS = 10, 20
SEED = "2024"

#: Bytes of text whose words are held at once, and documents whose counts are.
WINDOW, TOGETHER = 1 << 20, 64

# In UTF-8 and lower case: digits, letters and everything beyond ASCII.
_WORD, _BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _windows(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of data, window by window; none is cut."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            gap = _BREAK.search(data, end)
            end = gap.start() if gap else len(data)
        yield _WORD.findall(data[start:end].lower())
        start = end


def _buckets(data: bytes, n: int, buckets: int, size: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """Words and the features' buckets of each window; runs across windows belong to the later one."""
    before: list[bytes] = []
    for words in _windows(data, size):
        found = [np.fromiter(map(crc32, words), np.int64, len(words))]
        line = before + words
        for k in range(2, n + 1):
            # Runs that end in this window.
            first = max(len(before) - k + 1, 0)
            runs = [b" ".join(line[i : i + k]) for i in range(first, len(line) - k + 1)]
            found.append(np.fromiter(map(crc32, runs), np.int64, len(runs)))
        before = line[max(0, len(line) - n + 1) :] if n > 1 else []
        yield len(words), np.concatenate(found) % buckets


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for scalar in batch.column("text").cast(pa.binary()):
                for _, found in _buckets(scalar.as_py(), n, buckets):
                    np.add.at(sums, found, 1) if len(found) < buckets // 8 else np.add(sums, np.bincount(found, minlength=buckets), out=sums)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    parts = map_batches(_texts(texts), counted, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to source shares) of each bucket."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((int(t) + 1) * (s_all + buckets) / ((int(s) + 1) * (t_all + buckets))))
        for s, t in zip(source, target)
    ], np.int64)


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative whole numbers (rows x buckets): planes x rows x 64-bit words."""
    rows, width = numbers.shape
    depth = max(1, int(numbers.max(initial=0)).bit_length())
    bits = np.zeros((rows, -(-width // 64) * 64), bool)
    sliced = []
    for j in range(depth):
        bits[:, :width] = (numbers >> j) & 1
        sliced.append(np.packbits(bits, axis=1).view(np.uint64))
    return np.stack(sliced)


def sliced_sums(counts: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Sum of gain x count of every row, from the planes of the counts and those of gains above and below zero."""
    total = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(planes(counts)):
        live = np.flatnonzero(plane.any(axis=1))
        part = plane[live]
        for sign, gain in ((1, up), (-1, down)):
            for k in range(len(gain)):
                total[live] += (sign << (j + k)) * np.bitwise_count(part & gain[k]).sum(axis=1, dtype=np.int64)
    return total


def _draw(seed: str, doc_id: object) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(documents: DataFrame, gain: np.ndarray, n: int = N, seed: str = SEED, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gain)
    up, down = planes(np.maximum(gain, 0)[None])[:, 0], planes(np.maximum(-gain, 0)[None])[:, 0]
    rows = chosen(documents, doc_id=F.col("doc_id"), text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cuts(whole, "text"):
                for start in range(0, batch.num_rows, together):
                    part = batch.slice(start, together)
                    counts = np.zeros((part.num_rows, buckets), np.int32)
                    words = np.zeros(part.num_rows, np.int64)
                    for i, scalar in enumerate(part.column("text").cast(pa.binary())):
                        for held, found in _buckets(scalar.as_py(), n, buckets):
                            words[i] += held
                            counts[i] += np.bincount(found, minlength=buckets).astype(np.int32)
                    weight = sliced_sums(counts, up, down)
                    score = weight + np.array([_draw(seed, x) for x in part.column("doc_id").to_pylist()], np.int64)
                    features = counts.sum(axis=1, dtype=np.int64)
                    columns = [part.column("doc_id"), *map(pa.array, (words, features, weight, score))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return map_batches(rows, work, f"doc_id {id_type}, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """scored, a written table, with the rank (by score, then id) of its `draw` first rows; null for all others.

    Only partitions that begin before the last drawn row are numbered. Their sizes, one number per partition of
    the shuffle, are all that the driver sees.
    """
    spark: SparkSession = scored.sparkSession
    # The row's own number spreads rows that agree in score and id over several partitions.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = scored.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
    dealt = kept(dealt.withColumn("part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    starts, before = [], 0
    for part, size in sizes:
        starts.append((part, before))
        before += size
    begun = spark.createDataFrame(starts, "part int, before long")
    placed = dealt.join(F.broadcast(begun), "part")
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rank = F.when(number <= draw, number)
    early = placed.filter(F.col("before") < draw).withColumn("rank", rank)
    late = placed.filter(F.col("before") >= draw).withColumn("rank", F.lit(None).cast("long"))
    return early.unionByName(late).select(*scored.columns, "rank")


def resample(
    documents: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: str = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of documents."""
    gain = gains(bucket_counts(documents, n, buckets), bucket_counts(target, n, buckets))
    scored = kept(weigh(documents, gain, n, seed), "weights")
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = ranked(fit, percent * fit.count() // 100)
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(short).drop("n_words")
