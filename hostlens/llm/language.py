"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes one space, and its n-grams of one to three
characters are hashed into `BUCKETS` places. Training counts them for each language over all training
rows: each task adds up a vector for each language, the vectors are summed by a shuffle, and the matrix
of log-probabilities (languages x buckets, whatever the input's size) is broadcast. Scoring adds
matrix columns for the n-grams of many texts at once.

The log-likelihood is divided by the number of n-gram orders, which see the same characters, so
that short texts get moderate scores.

Defined cases: a null text, an empty one or one without a letter is `und` with score 0; rows without a
language are not learned from; equal scores go to the language that comes first in text order; without any
training rows every text is `und`; repeated rows are judged each for itself; an empty table gives an empty table.
A text may be as long as a row may be. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import chosen, cuts, release, released

BUCKETS = 1 << 14
ORDERS = 3
SMOOTHING = 0.5
UNKNOWN = "und"
#: Bytes of the texts that are judged at once, and characters of the n-grams held at once: beyond the text, a worker
#: holds a few bytes for each character of a cut or of one longer text.
CUT, WINDOW = 1 << 19, 1 << 18

_OTHER = re.compile(r"[\W\d_]+")
_STEP = np.uint32(0x9E3779B1)


def letters_only(text: str | None) -> str:
    """The text's words of letters, lower-cased, with one space around each; empty if it has no letter."""
    parts: list[str] = []
    for start in range(0, len(text or ""), WINDOW):  # a substitution holds every word of what it works on
        part = _OTHER.sub(" ", text[start : start + WINDOW])
        if parts and parts[-1].endswith(" "):
            part = part.removeprefix(" ")
        if part:
            parts.append(part)
    words = "".join(parts).strip().lower()
    return f" {words} " if any(c.isalpha() for c in words) else ""


def grams(texts: list[str], window: int | None = None) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of the joined texts, one row for each order, in windows of as many characters.

    Two zero characters follow each text; an n-gram that reaches into them marks the text's end. An n-gram belongs
    to the window of its first character, so windows only bound the memory.
    """
    window = window or WINDOW
    whole = "".join([t + "\0\0" for t in texts])
    for start in range(0, len(whole), window):
        seen = whole[start : start + window + ORDERS - 1].ljust(min(window, len(whole) - start) + ORDERS - 1, "\0")
        flat = np.frombuffer(seen.encode("utf-32-le"), "<u4")
        size = len(flat) - ORDERS + 1
        out = np.zeros((ORDERS, size), np.int32)
        state = np.zeros(size, np.uint32)
        for order in range(ORDERS):
            state = (state ^ flat[order : order + size]) * _STEP
            state ^= state >> np.uint32(15)
            out[order] = (state + np.uint32(order * 7919)) & np.uint32(BUCKETS - 1)
        yield out


def starts_of(texts: list[str]) -> np.ndarray:
    """Where each of the joined texts begins."""
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    return np.cumsum(sizes) - sizes


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, log-probabilities
    priors: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability, for each text."""
        clean = [letters_only(t) for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(clean) if t]
        if not rows or not self.languages:
            return names, scores
        kept_texts = [clean[i] for i in rows]
        starts = starts_of(kept_texts)
        sums, at = np.zeros((len(self.languages), len(rows))), 0
        for places in grams(kept_texts):
            end = at + places.shape[1]
            first, last = np.searchsorted(starts, [at, end - 1], "right") - 1
            bounds = np.maximum(starts[first : last + 1] - at, 0)
            for k, weights in enumerate(self.weights):
                sums[k, first : last + 1] += np.add.reduceat(weights[places].sum(axis=0, dtype=np.float64), bounds)
            at = end
        points = sums / ORDERS + self.priors[:, None]
        best = points.argmax(axis=0)
        share = 1.0 / np.exp(np.maximum(points - points.max(axis=0), -700)).sum(axis=0)
        for i, b, s in zip(rows, best, share, strict=True):
            names[i], scores[i] = self.languages[b], s
        return names, scores


def train(documents: DataFrame, training: Column | None = None) -> LanguageModel:
    """The model learned from all rows of documents (text, lang) for which `training` holds."""
    rows = documents if training is None else documents.filter(training)
    rows = chosen(rows, text=F.col("text"), lang=F.col("lang").cast("string")).filter(F.col("lang").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in cuts(batch, "text", CUT):
                clean = [letters_only(t) for t in part.column("text").to_pylist()]
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    texts = [clean[i] for i in np.flatnonzero(langs == lang) if clean[i]]
                    total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    total[BUCKETS] += len(texts)
                    if texts:
                        for places in grams(texts):
                            total[:BUCKETS] += np.bincount(places.ravel(), minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(lambda batches: released(run(batches)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most languages x (buckets + 1) rows
    languages = sorted(set(found["lang"]))
    counts = np.zeros((len(languages), BUCKETS + 1))
    counts[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy(int)] = found["n"]
    documents_of, counts = counts[:, BUCKETS], counts[:, :BUCKETS]
    weights = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    priors = np.log((documents_of + 1) / (documents_of.sum() + len(languages))) if languages else documents_of
    return LanguageModel(languages, weights.astype(np.float32), priors)


def judged(spark, model: LanguageModel):
    """A column function: text -> (lang_pred, score), with the model broadcast."""
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for part in cuts(pa.RecordBatch.from_arrays([texts], ["text"]), "text", CUT):
                n, s = shared.value.score(part.column("text").to_pylist())
                names += n
                scores.append(s)
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(flat)], ["lang_pred", "score"])
        release()

    return judge


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    judge = judged(documents.sparkSession, model)
    rows = chosen(documents, doc_id=F.col("doc_id"), judged=judge(F.col("text")))
    return rows.select("doc_id", "judged.lang_pred", "judged.score")
