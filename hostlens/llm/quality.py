"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into quantile bins. Boosting goes round the features: each step fits a
tree of at most three leaves to the gradient over one feature's bins and adds a small part of it to the
feature's lookup table. Afterwards the pairs whose grid explains most of what is left get tables
of their own, by trees that split both features once. A score is the sigmoid of a sum of table entries, looked
up for many texts at once.

The model is fitted on at most `SAMPLE` labelled training rows, those of the smallest hashed ids; scores cover every
whole text.

Defined cases: null counts as empty and gets a score like any text; labels other than 0 and 1, and
labels without a document, are not used; without labels of both kinds the score is the share of label 1, or
0.5 without any label; repeated rows are scored each for itself; constant features have one bin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import chosen, cuts

SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 6
ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 150, 4, 60, 0.15

FEATURES = [
    "log_chars", "log_words", "word_length", "repeats_neighbour", "distinct_words", "top_word",
    "bars", "signs", "exclamations", "capitals", "stops", "digits", "line_length", "repeated_lines",
]

_DELETE = {
    "bars": b"|",
    "signs": b"#$%&*@^~<>=+",
    "exclamations": b"!",
    "capitals": bytes(range(65, 91)),
    "stops": b".,;:?",
    "digits": b"0123456789",
}


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n, w = max(len(data), 1), max(len(words), 1)
    share = {k: (len(data) - len(data.translate(None, v))) / n for k, v in _DELETE.items()}
    found = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / w,
        sum(map(eq, words, words[1:])) / w,
        len(found) / w,
        max(found.values(), default=0) / w,
        *(share[k] for k in ("bars", "signs", "exclamations", "capitals", "stops", "digits")),
        float(np.log1p(len(data) / max(len(lines), 1))),
        1 - len(set(lines)) / max(len(lines), 1),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of the best tree over ordered bins, from sums of gradient and weight by bin."""
    value, spans = np.zeros(len(gradient)), [(0, len(gradient))]
    gain_of = lambda g, h: g * g / (h + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None)
        for a, b in spans:
            if b - a < 2:
                continue
            g, h = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
            gains = gain_of(g[:-1], h[:-1]) + gain_of(g[-1] - g[:-1], h[-1] - h[:-1]) - gain_of(g[-1], h[-1])
            k = int(gains.argmax())
            best = max(best, (float(gains[k]), (a, a + k + 1, b)), key=lambda x: x[0])
        if best[1] is None:
            break
        a, cut, b = best[1]
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
    for a, b in spans:
        value[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1.0)
    return value


def _grid_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of the tree that splits both features of a grid once, and its gain."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, value = 0.0, np.zeros_like(gradient)
    for i in range(gradient.shape[0] - 1):
        for j in range(gradient.shape[1] - 1):
            parts = lambda s: (s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j])  # noqa: B023, E731
            sums, weights = parts(g), parts(h)
            gain = sum(x * x / (y + 1.0) for x, y in zip(sums, weights, strict=True))
            if gain > best:
                leaf = [x / (y + 1.0) for x, y in zip(sums, weights, strict=True)]
                best, value = gain, np.zeros_like(gradient)
                value[: i + 1, : j + 1], value[: i + 1, j + 1 :] = leaf[0], leaf[1]
                value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = leaf[2], leaf[3]
    return value, best


@dataclass
class AdditiveModel:
    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def points(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        if self.pairs:
            cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]
            for (i, j), table in self.pairs.items():
                total += table[cells[i], cells[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.points(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of features x and labels y (0 or 1)."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    model.edges = [_edges(c, BINS) for c in x.T]
    cells = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    points = np.full(len(y), model.start)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-points))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, cell in enumerate(cells):
            gradient, weight = slope()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(cell, gradient, size), np.bincount(cell, weight, size))
            model.tables[k] += step
            points += step[cell]
    model.pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int) -> tuple[np.ndarray, float]:
        gradient, weight = slope()
        place, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        total = lambda v: np.bincount(place, v, sizes[i] * sizes[j]).reshape(shape)
        return _grid_tree(total(gradient), total(weight))

    count = len(FEATURES)
    gains = {(i, j): grid(i, j)[1] for i in range(count) for j in range(i + 1, count)}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]:
        model.pairs[pair] = np.zeros((sizes[pair[0]], sizes[pair[1]]))
    for _ in range(PAIR_ROUNDS):
        for i, j in model.pairs:
            step = RATE * grid(i, j)[0]
            model.pairs[i, j] += step
            points += step[coarse[i], coarse[j]]
    return model


def train(documents: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = SAMPLE) -> AdditiveModel:
    """The model fitted on labelled documents (doc_id, text; doc_id, quality) for which `training`, a
    condition on doc_id, holds."""
    rows = chosen(labels, doc_id=F.col("doc_id"), quality=F.col("quality").cast("int")).filter("quality in (0, 1)")
    rows = rows if training is None else rows.filter(training)
    # At most `sample` rows of two numbers.
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    joined = chosen(documents, doc_id=F.col("doc_id"), text=F.col("text")).join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, "text"):
                x = matrix(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))],
                    ["doc_id", "quality", "x"],
                )

    found = joined.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy("doc_id", "quality").limit(2 * sample).toPandas()
    if found.empty:
        return AdditiveModel(0.0)
    return fit(np.stack(found["x"].to_numpy()), found["quality"].to_numpy(float))


def judged(spark, model: AdditiveModel):
    """A column function: text -> score, with the model broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = [
                shared.value.score(matrix(part.column("text").to_pylist()))
                for part in cuts(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
            ]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return judge


def classify(documents: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    judge = judged(documents.sparkSession, model)
    scored = chosen(documents, doc_id=F.col("doc_id"), score=judge(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
