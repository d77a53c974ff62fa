"""Exact top-k inner products by dual-tree search over cover trees.

Queries and candidates are dealt into blocks; each pair of blocks is searched by
itself, so neither side is ever gathered in one task. Within a pair both sides
are indexed by a cover tree: children of a node are centres chosen farthest
first, every node has the radius that covers its points. A pair of nodes is
skipped when even the largest inner product that the radii allow is below the
worst kth score of every query in the query node. What is left is scored in
exact integers, and the blocks' winners are ranked once more.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without vec_id. Missing components of
shorter vectors count as zero. Ties go to the smaller vec_id. A query's own row
is no candidate, but another row with its vec_id is; each repeated query row is
a query. Scores beyond the range of a long are clipped to it. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestloom.llm.scratch import materialize

SCALE = 1024
LEAF = 48
FAN_OUT = 16
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
_EXACT = float(1 << 52)


@dataclass
class Node:
    """A cover-tree node: centre, covering radius, and children or the rows of a leaf."""

    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def build(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Cover tree over ``points``; identical points never split."""
    rows = np.arange(len(points)) if rows is None else rows
    mine = points[rows]
    center = mine[0]
    away = np.sqrt(((mine - center) ** 2).sum(axis=1))
    node = Node(center, float(away.max()), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    nearest, owner = away.copy(), np.zeros(len(rows), np.int64)
    for k in range(1, FAN_OUT):
        far = int(nearest.argmax())
        if nearest[far] <= node.radius / 4:
            break
        distance = np.sqrt(((mine - mine[far]) ** 2).sum(axis=1))
        closer = distance < nearest
        nearest[closer], owner[closer] = distance[closer], k
    node.children = [build(points, rows[owner == k]) for k in np.unique(owner)]
    return node


class DualSearch:
    """The k best candidates of every query, by (score descending, id ascending)."""

    def __init__(self, queries, query_ids, query_nth, candidates, ids, nth, k):
        self.q, self.c, self.k = queries, candidates, k
        self.query_ids, self.query_nth, self.ids, self.nth = query_ids, query_nth, ids, nth
        self.scores = np.full((len(queries), k), -np.inf if queries.dtype != object else None, dtype=queries.dtype if queries.dtype == object else float)
        self.best = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.filled = np.zeros((len(queries), k), bool)

    def run(self) -> None:
        points = [x.astype(float) for x in (self.q, self.c)]
        stack = [(build(points[0]), build(points[1]))]
        while stack:
            a, b = stack.pop()
            if self._bound(a, [b])[0] < self._worst(a):
                continue
            if not a.children and not b.children:
                self._score(a.rows, b.rows)
                continue
            left, right = a.children or [a], b.children or [b]
            for child in left:
                bounds = self._bound(child, right)
                stack += [(child, right[i]) for i in np.argsort(bounds, kind="stable")]  # the most promising is popped first

    def _bound(self, a: Node, others: list[Node]) -> np.ndarray:
        """No inner product between the nodes exceeds this."""
        centers, radii = np.stack([b.center for b in others]), np.array([b.radius for b in others])
        norms = np.sqrt((centers**2).sum(axis=1))
        bound = centers @ a.center + a.radius * norms + radii * np.sqrt((a.center**2).sum()) + a.radius * radii
        return bound + 1e-9 * np.abs(bound) + 1.0

    def _worst(self, a: Node) -> float:
        """The least kth score in a query node; minus infinity until all its queries have k."""
        if not self.filled[a.rows, -1].all():
            return -np.inf
        return float(min(self.scores[a.rows, -1]))

    def _score(self, rows: np.ndarray, others: np.ndarray) -> None:
        scores = self.q[rows] @ self.c[others].T
        ids = np.broadcast_to(self.ids[others], scores.shape)
        real = (self.query_ids[rows, None] != ids) | (self.query_nth[rows, None] != self.nth[others][None])
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.best[rows], ids], axis=1)
        real = np.concatenate([self.filled[rows], real], axis=1)
        rank = np.where(real, scores, -np.inf) if scores.dtype != object else scores
        for i, row in enumerate(rows):
            if scores.dtype == object:
                order = sorted(np.flatnonzero(real[i]), key=lambda j: (-scores[i, j], ids[i, j]))[: self.k]
            else:
                order = np.lexsort((ids[i], -rank[i]))[: self.k]
                order = order[real[i, order]]
            n = len(order)
            self.scores[row, :n], self.best[row, :n], self.filled[row, :n] = scores[i, order], ids[i, order], True


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers; exact doubles where products stay exact, Python integers otherwise."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width))
    lengths = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def search_blocks(table: pa.Table, k: int) -> pa.Table:
    """Winners of one pair of blocks: query_id, query_nth, vec_id, score."""
    table = table.combine_chunks()
    width = max(map(len, table.column("v").to_pylist()), default=0)
    is_query = table.column("is_query").to_numpy().astype(bool)
    vectors, ids, nth = _matrix(table.column("v"), width), table.column("vec_id").to_numpy(), table.column("nth").to_numpy()
    largest = np.abs(vectors).max(initial=0.0)
    if largest * largest * max(width, 1) >= _EXACT:
        vectors = np.array([[int(x) for x in row] for row in vectors], dtype=object).reshape(len(vectors), width)
    columns: dict[str, list] = {"query_id": [], "query_nth": [], "vec_id": [], "score": []}
    if is_query.any() and not is_query.all():
        search = DualSearch(vectors[is_query], ids[is_query], nth[is_query], vectors[~is_query], ids[~is_query], nth[~is_query], k)
        search.run()
        row, at = np.nonzero(search.filled)
        limit = (1 << 63) - 1
        columns = {
            "query_id": ids[is_query][row],
            "query_nth": nth[is_query][row],
            "vec_id": search.best[row, at],
            "score": [max(-limit - 1, min(limit, int(s))) for s in search.scores[row, at]],
        }
    return pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})


def top_inner_products(vectors: DataFrame, k: int = 10, divisor: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for every row whose id is divisible by ``divisor``."""
    usable = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    # F.floor of a double saturates at the range of a long; the fractional form keeps large components exact
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**42, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    rows = materialize(usable.select("vec_id", whole.alias("v")).withColumn("nth", nth.cast("long")))
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % divisor == 0, 1))).first()
    candidate_blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def block(count: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", "nth"), F.lit(count)).cast("int")

    def every(count: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    candidates = rows.select(block(candidate_blocks).alias("cb"), every(query_blocks).alias("qb"), F.lit(False).alias("is_query"), "vec_id", "nth", "v")
    queries = rows.where(F.col("vec_id") % divisor == 0).select(every(candidate_blocks).alias("cb"), block(query_blocks).alias("qb"), F.lit(True).alias("is_query"), "vec_id", "nth", "v")

    def run(pair: pa.Table) -> pa.Table:
        return search_blocks(pair, k)

    winners = candidates.unionByName(queries.select(*candidates.columns)).groupBy("cb", "qb").applyInArrow(run, "query_id long, query_nth long, vec_id long, score long")
    ranked = winners.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_nth").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
