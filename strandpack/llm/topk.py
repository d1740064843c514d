"""Operator 8, exact top-k search by inner product with a dual-tree cover-tree search.

Rows are dealt to shards by a hash of their id and queries to blocks; every block meets
every shard once, so all queries see all rows, in parallel and in bounded memory. In such
a pair both sides are indexed by a tree of covering balls: a node knows a centre and the
largest distance (covering radius) from it to any vector below. The pair (query node,
data node) is descended together; it is pruned when even the largest product that the
centres and radii allow, <cq, cx> + rq |cx| + rx |cq| + rq rx, is below the worst k-th
score of the query group. Data nodes are taken in order of that bound, so the k-th scores
rise quickly. The best k of each shard are merged for each query.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors are padded with zeros; ties go to the smaller id; rows with the query's
own id are not among its candidates; of repeated query ids the least vector counts, and
repeated rows are candidates each; scores beyond a long are cut at its limits; points that
lie equally far from each other stay together in one leaf; extra columns are left out,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandpack.llm import common

LEAF, FANOUT = 96, 8
#: Beyond this, sums of products may not be exact in doubles; what these cannot tell apart is then compared as integers.
EXACT = 1 << 20


class Node:
    """A ball of ``rows`` (indices) around ``centre``; children cover the same rows."""

    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray):
        self.rows, self.centre, self.norm = rows, centre, float(np.sqrt(centre @ centre))
        gaps = points[rows] - centre
        self.radius = float(np.sqrt((gaps * gaps).sum(1).max(initial=0.0))) * (1 + 1e-9) + 1e-6
        self.children: list[Node] = []


def build(points: np.ndarray, rows: np.ndarray, leaf: int, centre: np.ndarray | None = None, loose: int = 0) -> Node:
    """Balls of shrinking radius: each level's centres are points far from each other
    (farthest-point order), and every point goes to the nearest of them. Up to ``loose``
    rows stay together unless parting them gives a much smaller ball of several."""
    node = Node(points, rows, points[rows].mean(0) if centre is None else centre)
    if len(rows) <= leaf or node.radius < 1e-5:
        return node
    own = points[rows]
    far = int(((own - node.centre) ** 2).sum(1).argmax())
    nearest, best = np.zeros(len(rows), np.int64), ((own - own[far]) ** 2).sum(1)
    seeds = [far]
    for _ in range(FANOUT - 1):
        far = int(best.argmax())
        if best[far] <= 0:
            break
        gap = ((own - own[far]) ** 2).sum(1)
        closer = gap < best
        nearest[closer], best[closer] = len(seeds), gap[closer]
        seeds.append(far)
    if len(seeds) == 1 or not parts_well(node.radius, own, nearest, best):
        return node
    node.children = [build(points, rows[nearest == s], leaf, own[seed], loose) for s, seed in enumerate(seeds) if (nearest == s).any()]
    if len(rows) <= loose and not any(len(c.rows) > 1 and c.radius <= 0.7 * node.radius for c in node.children):
        node.children = []
    return node


def parts_well(radius: float, own: np.ndarray, nearest: np.ndarray, best: np.ndarray) -> bool:
    """Whether no seed keeps nearly all points at nearly the whole radius, so that trees stay shallow."""
    most = np.bincount(nearest).argmax()
    kept = nearest == most
    return kept.sum() <= 0.75 * len(own) or float(np.sqrt(best[kept].max())) <= 0.8 * radius


def bound(q: Node, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    top = centres @ q.centre + q.radius * norms + radii * q.norm + q.radius * radii
    return top + 1e-9 * np.abs(top) + 1e-3


class Search:
    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.q_ids, self.x, self.ids, self.k = queries, query_ids, data, ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.best = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.leaves = self.pruned = 0

    def run(self) -> None:
        if len(self.q) and len(self.x):
            self.descend(build(self.q, np.arange(len(self.q)), 4, loose=32), [build(self.x, np.arange(len(self.x)), LEAF)])

    def descend(self, q: Node, nodes: list[Node]) -> None:
        if q.children:
            # one level of the data tree for each of the query tree
            finer = [c for n in nodes for c in (n.children or [n])] if len(nodes) < 256 else nodes
            for child in q.children:
                self.descend(child, finer)
            return
        heap, order = [], 0

        def push(some: list[Node]) -> None:
            nonlocal order
            tops = bound(q, np.array([n.centre for n in some]), np.array([n.norm for n in some]), np.array([n.radius for n in some]))
            for top, n in zip(tops.tolist(), some):
                heapq.heappush(heap, (-top, order, n))
                order += 1

        push(nodes)
        while heap:
            top, _, n = heapq.heappop(heap)
            if -top < self.scores[q.rows, -1].min():
                self.pruned += len(heap) + 1
                return
            if n.children:
                push(n.children)
            else:
                self.leaves += 1
                self.score(q.rows, n.rows)

    def score(self, q: np.ndarray, x: np.ndarray) -> None:
        got = self.q[q] @ self.x[x].T
        got[self.q_ids[q][:, None] == self.ids[x][None, :]] = -np.inf
        # a column that improves on no row's k-th is left out (equal scores may win by their id)
        use = (got >= self.scores[q, -1][:, None]).any(0)
        if not use.any():
            return
        scores = np.hstack([self.scores[q], got[:, use]])
        ids = np.hstack([self.best[q], np.broadcast_to(self.ids[x][use], (len(q), int(use.sum())))])
        ids = np.where(np.isneginf(scores), np.iinfo(np.int64).max, ids)
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.scores[q], self.best[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def by_bounds(queries, query_ids, data, ids, k: int, block: int = 64):
    """The same result for components so large that doubles are not exact.

    Products of doubles, scaled by powers of two, are right but for a known error; what
    may be among the best k within that error is compared as integers.
    """
    limit = (1 << 63) - 1
    down = lambda m: np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=1.0))[1][:, None])
    scale = int(np.frexp(np.abs(data).max(initial=1.0))[1])
    x = np.ldexp(data, -scale)
    norms = np.sqrt((x * x).sum(1))
    for s in range(0, len(queries), block):
        q = down(queries[s : s + block])
        near, slack = q @ x.T, (np.sqrt((q * q).sum(1))[:, None] * norms) * (data.shape[1] + 4) * 2.0**-52 + 2.0**-1000
        for row, (got, err, qid) in enumerate(zip(near, slack, query_ids[s : s + block].tolist())):
            other = ids != qid
            low = np.where(other, got - err, -np.inf)
            least = np.partition(low, -k)[-k] if len(low) >= k else -np.inf
            some = np.flatnonzero(other & (got + err >= least))
            mine = [int(v) for v in queries[s + row].tolist()]
            scored = sorted((-sum(a * int(b) for a, b in zip(mine, data[i].tolist())), int(ids[i])) for i in some.tolist())
            yield from ((qid, i, max(-limit - 1, min(limit, -v))) for v, i in scored[:k])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        own = np.asarray(v.values, np.float64)
        out[i, : len(own)] = own
    return out


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors * scale)


def search(rows: DataFrame, is_query, k: int = 5, scale: float = 256.0, shard_rows: int = 8192, block_rows: int = 32768, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row where ``is_query`` holds."""
    spark = rows.sparkSession
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    data = rows.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    queries = rows.filter(sound & is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    n, n_queries, width = rows.filter(sound).agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size(vector_col))).first()
    shards, parts, width = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows)), max(1, width or 1)
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = queries.select(spread("id", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v")
    # a shard takes rows by their id and place in the input's hash, so that repeated ids do not gather
    right = data.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), "id", "v")

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        qm, xm = (scaled(matrix(t.column("v").combine_chunks(), width), scale) for t in (q, x))
        q_ids, ids = (t.column("id").to_numpy() for t in (q, x))
        found: list[tuple[int, int, int]] = []
        if len(qm) and len(xm):
            if max(np.abs(qm).max(), np.abs(xm).max()) > EXACT or width > 4096:
                found = list(by_bounds(qm, q_ids, xm, ids, k))
            else:
                s = Search(qm, q_ids, xm, ids, k)
                s.run()
                at, column = np.nonzero(~np.isneginf(s.scores))
                found = list(zip(q_ids[at].tolist(), s.best[at, column].tolist(), s.scores[at, column].astype(np.int64).tolist()))
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.int64())})

    best = left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
