"""Exact top-k search by inner product with two cover trees.

Vectors are integers: floor(1024 * x) of each component. Rows and queries are dealt to cells by the nearest of
at most `PIVOTS` pivots, and cells to blocks of at most `BLOCK` rows. In a task a block's rows get a cover tree
and the queries that meet the block get one; both are walked together. For nodes with centres q, r and
covering radii s, t no inner product exceeds <q, r> + |q| t + |r| s + s t; the pair is left out if that is less
than the worst k-th score known to any query below the query node.

First the queries meet the blocks of their own cell. Their k-th scores then decide, by the same bound, which
other cells each query must meet; the answers are merged by a window that keeps k rows for a query before its shuffle.

The pivots come from a bounded sample and only deal out work: every row is indexed, the result is exact.

Defined cases: vectors that are null or hold a null, a NaN or an infinity take no part, nor do rows without an id;
shorter vectors are filled up with zeros; a query's own id is no candidate; repeated rows are candidates each for
itself and one query together (that of the smallest vector, if they differ); equal scores rank by the smaller id.
Where two vectors are so long that doubles do not hold their products, they are multiplied as whole numbers. Vectors whose
products do not fit the long score (of a length from 3.0e9, in integers) are refused with an error. An empty table
gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, kept

K = 10
SCALE = 1024
PIVOTS, SAMPLE = 64, 2048
#: Rows of a block, queries that meet a block in one task, and vectors of a leaf.
BLOCK, QUERY_BLOCK, LEAF, FAN = 8192, 4096, 48, 12
#: Below this doubles hold whole numbers exactly; no score is as low as LOWEST.
EXACT, LOWEST = 2.0**53, -(2**63)


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    norm: float
    radius: float
    longest: float
    children: list[Node] = field(default_factory=list)


def cover_tree(vectors: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """The tree over vectors: each node covers its rows within its radius; its children's centres are chosen
    farthest first, so they lie at least their covering distance apart."""
    rows = np.arange(len(vectors)) if rows is None else rows
    own = vectors[rows]
    centre = own[0]
    away = np.sqrt(((own - centre) ** 2).sum(axis=1))
    norm, radius = float(np.sqrt((centre * centre).sum())), float(away.max())
    node = Node(rows, centre, norm, radius, (norm + radius) * (1 + 1e-9))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    nearest, at = away, np.zeros(len(rows), np.int64)
    for k in range(1, FAN):
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        distance = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
        closer = distance < nearest
        nearest, at = np.where(closer, distance, nearest), np.where(closer, k, at)
    for k in range(int(at.max()) + 1):
        part = np.flatnonzero(at == k)
        # The centre, at distance zero, comes first.
        node.children.append(cover_tree(vectors, rows[part[np.argsort(nearest[part], kind="stable")]]))
    return node


class Search:
    """Best k candidates of each query; ids and scores, the best first."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, known: np.ndarray):
        self.queries, self.query_ids, self.candidates, self.ids, self.k = queries, query_ids, candidates, ids, k
        #: A score below which a candidate cannot be among the query's best.
        self.worst = known.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        self.pairs = 0

    def run(self) -> None:
        if len(self.query_ids) and len(self.ids):
            self._walk(cover_tree(self.queries), cover_tree(self.candidates))

    def _bound(self, q: Node, r: Node) -> float:
        top = float(q.centre @ r.centre) + q.norm * r.radius + r.norm * q.radius + q.radius * r.radius
        return top + 1e-9 * abs(top) + 1e-12 * q.longest * r.longest + 1e-6  # for the rounding of products, norms and radii

    def _walk(self, q: Node, r: Node) -> None:
        if self._bound(q, r) < float(self.worst[q.rows].min()):
            return
        if not q.children and not r.children:
            self._leaves(q, r)
        elif q.children and (not r.children or q.radius > r.radius):
            for child in q.children:
                self._walk(child, r)
        else:
            for child in sorted(r.children, key=lambda c: -self._bound(q, c)):
                self._walk(q, child)

    def _leaves(self, q: Node, r: Node) -> None:
        asked, rows = self.queries[q.rows], self.candidates[r.rows]
        if q.longest * r.longest < EXACT:
            scores = (asked @ rows.T).astype(np.int64)
        else:
            scores = asked.astype(np.int64) @ rows.astype(np.int64).T
        ids = self.ids[r.rows]
        self.pairs += scores.size
        for i, row in enumerate(q.rows):
            keep = (scores[i] >= self.worst[row]) & (ids != self.query_ids[row])
            if not keep.any():
                continue
            held, names = self.best[row]
            held, names = np.concatenate([held, scores[i][keep]]), np.concatenate([names, ids[keep]])
            order = np.lexsort((names, -held))[: self.k]
            self.best[row] = held[order], names[order]
            if len(order) == self.k:
                self.worst[row] = max(self.worst[row], held[order[-1]])


def _whole(batch_column: pa.Array, width: int) -> np.ndarray:
    """Rows of integer lists as doubles, which hold them exactly (see search)."""
    out = np.zeros((len(batch_column), width))
    sizes = np.diff(batch_column.offsets.to_numpy())
    flat = batch_column.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        out[np.arange(width) < sizes[:, None]] = flat
    return out


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, as integers."""
    x = F.col("x")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = chosen(embeddings, vec_id=F.col("vec_id").cast("long"), x=F.col("embedding").cast("array<double>"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def _pivots(rows: DataFrame, width: int) -> np.ndarray:
    """At most PIVOTS vectors, chosen farthest first from a sample of at most SAMPLE rows."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    points = _whole(sample, width)
    chosen_rows, nearest = [0], np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen_rows) < PIVOTS and nearest.max() > 0:
        far = int(nearest.argmax())
        chosen_rows.append(far)
        nearest = np.minimum(nearest, np.sqrt(((points - points[far]) ** 2).sum(axis=1)))
    return points[chosen_rows]


_FOUND = "query_id long, vec_id long, score long"


def _search(candidates: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """The best k of each block for each query that meets it; both sides are keyed by cell, part, lot."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        empty = {n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")}
        if not rows.num_rows or not asked.num_rows:
            return pa.table(empty)
        search = Search(
            _whole(asked.column("v").combine_chunks(), width),
            asked.column("vec_id").to_numpy(),
            _whole(rows.column("v").combine_chunks(), width),
            rows.column("vec_id").to_numpy(),
            k,
            asked.column("worst").to_numpy().astype(np.int64),
        )
        search.run()
        sizes = [len(n) for _, n in search.best]
        return pa.table({
            "query_id": pa.array(np.repeat(search.query_ids, sizes)),
            "vec_id": pa.array(np.concatenate([n for _, n in search.best])),
            "score": pa.array(np.concatenate([s for s, _ in search.best])),
        })

    key = ["cell", "part", "lot"]
    return candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the best k rows for each row for which is_query, a condition on vec_id, holds."""
    spark = embeddings.sparkSession
    rows = kept(vectors(embeddings), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, e: total + e.cast("double") * e.cast("double"))
    shape = rows.agg(F.max(F.size("v")), F.max(square)).first()
    width, largest = max(shape[0] or 0, 1), shape[1] or 0.0
    if largest >= 0.99 * 2.0**63:
        raise ValueError("inner products exceed what a long holds")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if shape[0] is None:
        return empty
    shared = spark.sparkContext.broadcast(_pivots(rows, width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        squares = (pivots * pivots).sum(axis=1)
        for batch in batches:
            v = _whole(batch.column("v"), width)
            cell = (squares - 2 * (v @ pivots.T)).argmin(axis=1)
            away = np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cell), pa.array(away)], ["vec_id", "v", "cell", "away"]
            )

    dealt = kept(rows.mapInArrow(deal, "vec_id long, v array<long>, cell long, away double"), "dealt")
    # One row for each cell.
    cells = dealt.groupBy("cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("parts")).toPandas()
    radius = np.full(len(shared.value), -1.0)
    radius[cells["cell"]] = cells["radius"]
    asked = dealt.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q")).select("vec_id", "q.v", "q.cell")
    asked = kept(asked, "queries")
    lots = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = F.broadcast(spark.createDataFrame(cells[["cell", "parts"]]))  # PIVOTS rows
    in_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    lot_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots)).alias("lot")
    # A block meets all lots of queries, each in a task of its own.
    blocks = dealt.join(parts, "cell").select(
        "cell", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"),
    )

    def meet(queries: DataFrame) -> DataFrame:
        dealt_out = queries.join(parts, "cell").select("cell", "vec_id", "v", "worst", in_parts, lot_of)
        return _search(blocks, dealt_out, k, width)

    lowest = F.lit(LOWEST).cast("long")
    near = kept(meet(asked.withColumn("worst", lowest)), "near")
    worst = _best(near, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    known = asked.join(worst, "vec_id", "left").withColumn("worst", F.coalesce("worst", lowest))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        norms = np.sqrt((pivots * pivots).sum(axis=1))
        for batch in batches:
            v, own = _whole(batch.column("v"), width), batch.column("cell").to_numpy()
            least = batch.column("worst").to_numpy()
            length = np.sqrt((v * v).sum(axis=1))
            bound = v @ pivots.T + length[:, None] * radius
            slack = 1e-9 * np.abs(bound) + 1e-12 * length[:, None] * (norms + np.abs(radius)) + 1e-6
            met = (bound + slack >= least[:, None].astype(float)) & (radius >= 0)
            met[np.arange(len(v)), own] = False
            row, cell = np.nonzero(met)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken.column("vec_id"), taken.column("v"), pa.array(cell), taken.column("worst")], ["vec_id", "v", "cell", "worst"])

    far = meet(known.select("vec_id", "v", "cell", "worst").mapInArrow(others, "vec_id long, v array<long>, cell long, worst long"))
    return _best(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")
