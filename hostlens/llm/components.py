"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import kept

#: Edges that one task settles at once (16 MB); more are contracted by shuffles first.
TASK_EDGES = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges (a, b) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lot = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if lot:
        node, up = smallest_reachable(*(np.concatenate(c) for c in zip(*lot, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(up)], ["a", "up"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, for each node of edges (a, b).

    In each round every node takes its smallest neighbour as parent, parents are followed twice, and the
    edges between parents are the next round's. Each round is written to the shared folder; what is left
    shrinks by a factor, so their number grows with the logarithm of the largest group. As soon as no more than
    TASK_EDGES edges are left, one task settles them.
    """
    spark = edges.sparkSession
    rounds: list[DataFrame] = []
    left = kept(edges.select("a", "b").filter("a != b").distinct(), "edges")
    while count := left.count():
        if count <= TASK_EDGES:
            rounds.append(kept(left.coalesce(1).mapInArrow(_settled, "a long, up long"), "parents"))
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "parents")
        for _ in range(2):
            above = parent.select(F.col("a").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up").select("a", F.col("top").alias("up"))
        parent = kept(parent, "parents")
        rounds.append(parent)
        to = lambda c: parent.select(F.col("a").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        left = kept(
            left.join(to("a"), "a").join(to("b"), "b")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
            .filter("a != b").distinct(),
            "edges",
        )
    if not rounds:
        return spark.createDataFrame([], "node long, label long")
    labels = rounds[0].select(F.col("a").alias("node"), F.col("up").alias("label"))
    for parent in rounds[1:]:
        above = parent.select(F.col("a").alias("label"), F.col("up").alias("top"))
        labels = labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return kept(labels, "labels") if len(rounds) > 1 else labels
