"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

An inner product becomes a distance by one more coordinate: with M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) and
q -> (q, 0), and |q - x|^2 = |q|^2 + M^2 - 2 q.x, so nearest means largest product.  Vectors are dealt into shards of
bounded size; every shard builds a tree: a vantage point splits its vectors at the median distance, leaves hold a few
dozen.  All queries of a block go down a tree together.  A branch is skipped for a query when the triangle inequality
puts it beyond the k-th distance found, times `factor`: with factor one only branches that cannot hold a result are
skipped, smaller factors skip more.  The distance serves for skipping only, with a slack for its rounding, which grows
with M^2.  Points are ranked and cut by products of the original vectors in double precision, then by vec_id.

Equal vectors of a shard are one point of its tree, in order of their smallest vec_id.  A shard returns at most k rows
per query, and these are ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.sources.scratch import stage_table

K = 20
SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
LEAF = 64
FACTOR = 1.0
EPS = float(np.finfo(np.float64).eps)


class VantageTree:
    """A tree over distinct points [n, d], as nested tuples (vantage row, radius, inside, outside) or row arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.points, self.leaf, self.rng = points, leaf, np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = self.rng.integers(len(rows))
        vantage, rest = rows[at], np.delete(rows, at)
        distance = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(axis=1))
        radius = np.median(distance)
        inside = distance <= radius
        if inside.all():  # the median is the largest distance: nothing to split by
            return rows
        return vantage, radius, self._grow(rest[inside]), self._grow(rest[~inside])


class Search:
    """The k best points of a tree for a block of queries: the nearest, or with `vectors`, one for each point of the
    tree, those of largest product with the query's first components.  Ties go to the smaller row.

    `exclude` names a row per query that is no result (-1: none).
    """

    def __init__(self, tree: VantageTree, queries: np.ndarray, k: int, factor: float, exclude: np.ndarray, vectors: np.ndarray | None = None):
        self.tree, self.queries, self.k, self.factor, self.exclude = tree, queries, k, factor, exclude
        self.best = np.full((len(queries), k), -np.inf)  # scores: products, or negative distances
        self.rows = np.full((len(queries), k), -1)
        self.squares = (queries**2).sum(axis=1)
        self.point_squares = (tree.points**2).sum(axis=1)
        self.largest = self.point_squares.max(initial=0.0)
        width = tree.points.shape[1] if len(tree.points) else 0
        self.slack = 8 * (width + 4) * EPS * (self.squares + self.largest)  # error of a computed squared distance
        self.vectors = vectors
        if vectors is not None:
            self.columns, self.query_columns = np.ascontiguousarray(vectors.T), np.ascontiguousarray(queries[:, : vectors.shape[1]].T)
            self.lengths, self.query_lengths = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((self.query_columns**2).sum(axis=0))
        if len(queries) and len(tree.points):
            self._visit(tree.root, np.arange(len(queries)))

    def _distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        square = self.squares[q][:, None] + self.point_squares[rows][None, :] - 2 * self.queries[q] @ self.tree.points[rows].T
        return np.sqrt(np.maximum(square, 0))

    def _products(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Products, one component after another; -inf where a rougher one is surely below the k-th."""
        rough = self.query_columns[:, q].T @ self.columns[:, rows]
        margin = 4 * (len(self.columns) + 4) * EPS * self.query_lengths[q][:, None] * self.lengths[rows][None, :]
        at, point = np.nonzero(~(rough + margin < self.best[q].min(axis=1)[:, None]))
        one, other = q[at], rows[point]
        exact = np.zeros(len(at))
        for mine, theirs in zip(self.query_columns, self.columns):
            exact += mine[one] * theirs[other]
        out = np.full(rough.shape, -np.inf)
        out[at, point] = exact
        return out

    def _offer(self, q: np.ndarray, rows: np.ndarray) -> None:
        """Consider points for queries."""
        score = -self._distances(q, rows) if self.vectors is None else self._products(q, rows)
        score = np.where(rows[None, :] == self.exclude[q][:, None], -np.inf, score)
        some = np.flatnonzero((score >= self.best[q].min(axis=1)[:, None]).any(axis=1))
        q, score = q[some], score[some]
        every = np.concatenate([self.best[q], score], axis=1)
        names = np.concatenate([self.rows[q], np.broadcast_to(rows, score.shape)], axis=1)
        names = np.where(every == -np.inf, -1, names)
        pick = np.argpartition(-every, self.k - 1, axis=1)[:, : self.k]
        least = np.take_along_axis(every, pick, 1).min(axis=1)
        tied = np.flatnonzero(((every >= least[:, None]).sum(axis=1) > self.k) & (least > -np.inf))
        if len(tied):  # more points share the k-th score than fit
            pick[tied] = np.lexsort((names[tied], -every[tied]), axis=1)[:, : self.k]
        self.best[q], self.rows[q] = np.take_along_axis(every, pick, 1), np.take_along_axis(names, pick, 1)

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """The distance, or more, up to which points can still be results."""
        worst = self.best[q].min(axis=1)
        square = worst**2 if self.vectors is None else np.maximum(self.squares[q] + self.largest - 2 * worst, 0)
        return np.sqrt(square * self.factor**2 + self.slack[q])

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self._offer(q, node)
            return
        vantage, radius, inside, outside = node
        self._offer(q, np.array([vantage]))
        distance = self._distances(q, np.array([vantage]))[:, 0]
        near_inside = distance <= radius
        square, slack = distance**2, self.slack[q]
        low, high = np.sqrt(np.maximum(square - slack, 0)), np.sqrt(square + slack)
        least_radius, most_radius = np.sqrt(np.maximum(radius**2 - slack, 0)), np.sqrt(radius**2 + slack)
        for first in (True, False):  # the side the query lies on, then the other where it can still matter
            for side, on_side, gap in ((inside, near_inside, low - most_radius), (outside, ~near_inside, least_radius - high)):
                mine = on_side if first else ~on_side & ~(gap > self._reach(q))
                self._visit(side, q[mine])


def _search(k: int, factor: float, leaf: int, largest: float):
    def run(key: tuple, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(points) or not len(queries):
            return pd.DataFrame({c: [] for c in columns})
        points = points.sort_values("vec_id")
        x, ids, copies = np.stack(points["embedding"]).astype(np.float64), points["vec_id"].to_numpy(), np.minimum(points["copies"].to_numpy(), k)
        q, query_ids = np.stack(queries["embedding"]).astype(np.float64), queries["query_id"].to_numpy()
        distinct, first, at = np.unique(x, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)  # rows of the tree follow the smallest id of their vectors
        distinct, at = distinct[order], np.argsort(order)[at.ravel()]
        members = np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at))[:-1])  # of one point, smallest id first
        lift = np.sqrt(np.maximum(largest**2 - (distinct**2).sum(axis=1), 0))
        tree = VantageTree(np.concatenate([distinct, lift[:, None]], axis=1), leaf)
        names, often = np.unique(ids, return_counts=True)
        slots = k + int(often[np.isin(names, query_ids)].max(initial=0))  # rows of the query's own id go at the end
        found = Search(tree, np.concatenate([q, np.zeros((len(q), 1))], axis=1), slots, factor, np.full(len(q), -1), distinct)
        out = []
        for i, query_id in enumerate(query_ids):
            rows = found.rows[i][found.rows[i] >= 0]
            rows = np.concatenate([members[r][:slots] for r in rows]) if len(rows) else rows
            rows = rows[ids[rows] != query_id]
            rows = np.repeat(rows, copies[rows])
            score = np.cumsum(x[rows] * q[i], axis=1)[:, -1]  # one component after another
            best = np.lexsort((ids[rows], -score))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of vectors that take part: no NULL, no zero vector, all components finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .filter("vec_id is not null and embedding is not null")
        .filter(finite & F.exists("embedding", lambda x: x != 0))
    )


def nearest(
    vectors: DataFrame, every: int = 20, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every row whose id is divisible by `every`.

    Candidates are all rows but the query's own id, compared where lengths agree; ties go to the smaller vec_id.
    Takes vec_id and embedding; other columns are not read.  Rows without an id, and vectors that are NULL, zero,
    empty or not finite, take no part.  Rows that repeat an id and vector are one query, but as many candidates: they are
    searched once and come out as often as they are there.  No rows from an empty table.
    """
    counted = usable(vectors).groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    kept = stage_table(counted.withColumn("size", F.size("embedding")), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    rows, largest = kept.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    shards = max(1, -(-rows // shard_rows))
    blocks = max(1, -(-rows // (every * query_rows)))
    dealt = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    points = kept.withColumn("shard", dealt("vec_id", shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = (
        kept.filter(F.col("vec_id") % every == 0)
        .select(F.col("vec_id").alias("query_id"), "embedding", F.col("size").alias("q_size"), dealt("vec_id", blocks, 2).alias("q_block"))
        .withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    found = points.groupBy("size", "shard", "block").cogroup(queries.groupBy("q_size", "q_shard", "q_block")).applyInPandas(
        _search(k, factor, leaf, float(largest or 0)), "query_id long, vec_id long, score double"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
