"""Exact top-k by inner product with a k-d tree in every shard.

Vectors are turned into integers. Rows are dealt into shards of about ``SHARD`` rows by a hash of
their id, queries into blocks of about ``BLOCK``. For every shard and block one task builds a k-d
tree: median splits along the widest dimension, a tight bounding box at every node. A query walks it
best first: the largest inner product a box allows is its bound, and a node whose bound is below the
query's k-th score is left out with all below it.

The k-th score is propagated twice. A first pass scores every query against the rows of a bounded,
hash-chosen set; its k-th score there is a floor that travels with the query into every shard. Within
a shard it rises with the hits found. Ties are kept until ids decide them, so results are exact.

Queries and candidates meet only in blocks, and only with vectors of their own length. Nulls: a null
vector, or one that holds a null or non-finite component, takes no part; nor does a row without id.
Rows that share an id are one vector's row, and a query skips all rows of its id. Components of about
2**20 and more do not fit: scores must fit into 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickgrain.session import park

SHARD = 2048
BLOCK = 1024
LEAF = 64
SEEDS = 512


class Tree:
    """Nodes in arrays: box, rows [begin, end) of ``order``, left and right child or -1."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(points))
        low, high, begin, end, left, right = [], [], [], [], [], []

        def build(a: int, b: int) -> int:
            own = points[self.order[a:b]]
            node = len(low)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            begin.append(a)
            end.append(b)
            left.append(-1)
            right.append(-1)
            width = high[node] - low[node]
            axis = int(width.argmax())
            if b - a > LEAF and width[axis] > 0:
                values = own[:, axis]
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(values, middle, kind="introselect")]
                left[node] = build(a, a + middle)
                right[node] = build(a + middle, b)
            return node

        build(0, len(points))
        self.points, self.ids = points[self.order], ids[self.order]
        self.low, self.high = np.array(low), np.array(high)
        self.begin, self.end, self.left, self.right = begin, end, left, right

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the largest inner product with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the up to ``k`` best rows that reach the floor."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting = [(-bounds[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < floor:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= floor:
                        heapq.heappush(waiting, (-bounds[child], child))
                continue
            some = slice(self.begin[node], self.end[node])
            found = self.points[some] @ query
            ok = np.flatnonzero((found >= floor) & (self.ids[some] != own))
            if ok.size:
                ids, scores = np.concatenate([ids, self.ids[some][ok]]), np.concatenate([scores, found[ok].astype(np.int64)])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if ids.size == k:
                    floor = max(floor, scores[-1])
        return ids, scores


def integer_vectors(vectors: DataFrame, column: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim): floor(scale * x) of every component, of the rows that take part."""
    x = F.col(column)
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))), F.lit(False)) & (F.size(x) > 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"), F.size(x).alias("dim"))


def _matrix(column: pd.Series) -> np.ndarray:
    """Integer rows; as doubles while every sum of products stays exact in them, which is faster."""
    out = np.array(column.tolist(), np.int64)
    largest = max(1, int(np.abs(out).max()))
    return out.astype(np.float64) if largest**2 * out.shape[1] < 1 << 52 else out


def _pair(points: pd.Series, queries: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    p, q = _matrix(points), _matrix(queries)
    largest = max(1, int(np.abs(p).max())) * max(1, int(np.abs(q).max()))
    if largest * p.shape[1] < 1 << 52:
        return p.astype(np.float64), q.astype(np.float64)
    return p.astype(np.int64), q.astype(np.int64)


def _floors(queries: pd.DataFrame, seeds: pd.DataFrame, k: int) -> pd.DataFrame:
    out = queries[["vec_id"]].assign(floor=np.iinfo(np.int64).min)
    if len(seeds) and len(queries):
        p, q = _pair(seeds["v"], queries["v"])
        scores = (q @ p.T).astype(np.int64)
        scores[queries["vec_id"].to_numpy()[:, None] == seeds["vec_id"].to_numpy()[None, :]] = np.iinfo(np.int64).min
        if scores.shape[1] >= k:
            out["floor"] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def _hits(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    rows: list[tuple] = []
    if len(points) and len(queries):
        p, q = _pair(points["v"], queries["v"])
        tree = Tree(p, points["vec_id"].to_numpy(np.int64))
        bounds = tree.bounds(q)
        for i, (own, floor) in enumerate(zip(queries["vec_id"].tolist(), queries["floor"].tolist())):
            ids, scores = tree.search(q[i], own, bounds[i], floor, k)
            rows += [(own, a, b) for a, b in zip(ids.tolist(), scores.tolist())]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, v, dim) for the rows that ``is_query`` picks."""
    vectors = park(vectors, "vectors")
    rows = vectors.count()
    queries = vectors.filter(is_query).dropDuplicates(["vec_id"])
    shards, blocks = max(1, -(-rows // SHARD)), max(1, -(-queries.count() // BLOCK))
    # A set of about SEEDS rows, one copy for every block of queries.
    drawn = F.pmod(F.xxhash64(F.lit("seed"), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    seeds = vectors.filter(drawn < F.lit(min(1.0, SEEDS / max(rows, 1)))).dropDuplicates(["vec_id"])
    placed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    copied = seeds.withColumn("block", every_block)
    floors = placed.groupBy("dim", "block").cogroup(copied.groupBy("dim", "block")).applyInPandas(lambda q, s: _floors(q, s, k), "vec_id long, floor long")
    known = park(placed.join(floors, "vec_id"), "queries")
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards))).withColumn("block", every_block)
    right = known.withColumn("shard", every_shard)
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda p, q: _hits(p, q, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
