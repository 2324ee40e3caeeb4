"""K-means for many numbers of clusters and many starts at once, on dense or sparse rows.

All fits share their passes: an iteration is one scan in which each task finds the nearest centre of every fit for its
rows, a block of rows against all centres in one product, and returns one sum per cluster.  Sums of tasks add up, so the
rows are never shuffled; centres, bounded by fits x clusters x terms, are what the driver holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 20
TOLERANCE = 1e-4  # a fit ends when no centre moves further
SAMPLE_CELLS = 4_000_000  # numbers of the sample that starts are drawn from, SAMPLE_ROWS rows at most
SAMPLE_ROWS = 2_000
BLOCK_CELLS = 2_000_000
SUMS = "cell int, i int, s double"


class Block:
    """Rows of a pass, dense (a matrix) or sparse (entries by row)."""

    def __init__(self, rows: pd.DataFrame, size: int):
        self.n, self.size = len(rows), size
        if "term_ids" in rows:
            self.dense = None
            lengths = rows["term_ids"].map(len).to_numpy(np.int64)
            self.row = np.repeat(np.arange(self.n), lengths)
            self.term = np.concatenate([np.zeros(0, np.int64), *rows["term_ids"]]).astype(np.int64)
            self.weight = np.concatenate([np.zeros(0), *rows["weights"]])
            self.squares = np.bincount(self.row, self.weight**2, minlength=self.n)
        else:
            self.dense = np.vstack(rows["x"].to_numpy()) if self.n else np.zeros((0, size))
            self.squares = (self.dense**2).sum(axis=1)

    def products(self, centres: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ centres.T
        out = np.zeros((self.n, len(centres)))
        for lo in range(0, len(self.term), step := max(1, BLOCK_CELLS // len(centres))):
            part = slice(lo, lo + step)
            np.add.at(out, self.row[part], self.weight[part, None] * centres[:, self.term[part]].T)
        return out

    def sums(self, nearest: np.ndarray, k: int) -> np.ndarray:
        if self.dense is not None:
            return np.equal.outer(np.arange(k), nearest).astype(float) @ self.dense
        return np.bincount(nearest[self.row] * self.size + self.term, self.weight, minlength=k * self.size).reshape(k, self.size)

    def to_dense(self) -> np.ndarray:
        if self.dense is not None:
            return self.dense
        out = np.zeros((self.n, self.size))
        out[self.row, self.term] = self.weight
        return out


def _blocks(batches: Iterator[pd.DataFrame], size: int, centres: int) -> Iterator[Block]:
    step = max(1, BLOCK_CELLS // max(1, centres))
    for b in batches:
        for lo in range(0, len(b), step):
            yield Block(b.iloc[lo : lo + step], size)


def _distances(block: Block, centres: np.ndarray) -> np.ndarray:
    return np.maximum(block.squares[:, None] - 2 * block.products(centres) + (centres**2).sum(axis=1), 0)


def _sum_pass(fits: list[np.ndarray], size: int):
    """Per cluster of every fit: the sum of its rows, their number (i = -1), cost (-2) and sum of squares (-3)."""
    every = np.concatenate(fits)
    begin = np.cumsum([0, *map(len, fits)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(every), size))
        facts = np.zeros((len(every), 3))
        for block in _blocks(batches, size, len(every)):
            far = _distances(block, every)
            for lo, hi in zip(begin, begin[1:]):
                nearest = far[:, lo:hi].argmin(axis=1)
                sums[lo:hi] += block.sums(nearest, hi - lo)
                least = far[np.arange(block.n), lo + nearest]
                for j, w in enumerate((None, least, block.squares)):
                    facts[lo:hi, j] += np.bincount(nearest, w, minlength=hi - lo)
        cell, i = np.nonzero(sums)
        yield pd.DataFrame({"cell": cell, "i": i, "s": sums[cell, i]})
        cell, j = np.nonzero(facts)
        yield pd.DataFrame({"cell": cell, "i": -1 - j, "s": facts[cell, j]})

    return run


@dataclass
class Sums:
    """Of one fit's clusters."""

    sums: np.ndarray
    counts: np.ndarray
    costs: np.ndarray
    squares: np.ndarray


def _one_pass(rows: DataFrame, fits: list[np.ndarray], size: int) -> list[Sums]:
    got = rows.mapInPandas(_sum_pass(fits, size), SUMS).groupBy("cell", "i").agg(F.sum("s").alias("s")).toPandas()  # fits x clusters x terms numbers
    n = sum(map(len, fits))
    table = np.zeros((n, size + 3))
    table[got["cell"].to_numpy(np.int64), got["i"].to_numpy(np.int64) % (size + 3)] = got["s"]  # -1, -2, -3 are the last columns
    out, at = [], 0
    for f in fits:
        t = table[at : at + len(f)]
        out.append(Sums(t[:, :size], t[:, -1], t[:, -2], t[:, -3]))
        at += len(f)
    return out


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the sample, each drawn by its squared distance to those before; repeats when rows run out."""
    picked = [int(rng.integers(len(sample)))]
    far = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        total = far.sum()
        picked.append(int(rng.choice(len(sample), p=far / total)) if total > 0 else int(rng.integers(len(sample))))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


@dataclass
class Clusters:
    """Centres of one fit."""

    centres: np.ndarray

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  the name MLlib's models use
        return list(self.centres)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `prediction`, the nearest centre of each row of dense `features`; of equal ones the first."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="int32")
            return pd.Series(_distances(Block(pd.DataFrame({"x": x}), centres.shape[1]), centres).argmin(axis=1).astype("int32"), index=x.index)

        return rows.withColumn("prediction", nearest(vector_to_array("features")))


def _silhouette_pass(fits: list[np.ndarray], found: list[Sums], size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(fits))
        for block in _blocks(batches, size, sum(map(len, fits))):
            for f, (centres, of) in enumerate(zip(fits, found)):
                own = _distances(block, centres).argmin(axis=1)
                n = of.counts[None, :]
                whole = n * block.squares[:, None] + of.squares - 2 * block.products(of.sums)  # squared distances to a cluster's rows
                row = np.arange(block.n)
                mine = whole[row, own] / np.maximum(of.counts[own] - 1, 1)
                others = np.where(n > 0, whole / np.maximum(n, 1), np.inf)
                others[row, own] = np.inf
                other = others.min(axis=1)
                most = np.maximum(mine, other)
                good = (of.counts[own] > 1) & (most > 0) & np.isfinite(other)
                total[f] += ((other - mine)[good] / most[good]).sum()
        yield pd.DataFrame({"cell": np.arange(len(fits)), "i": 0, "s": total})

    return run


def sweep(
    rows: DataFrame, size: int | None = None, ks: Sequence[int] = (8, 9, 10, 11, 12), seed: int = 42, starts: int = 3, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> tuple[list[tuple], dict[int, Clusters]]:
    """(k, silhouette, sizes, costs of all starts) per k, and the centres of the cheapest start of each.

    Rows have `features` (dense vectors), or `term_ids` and `weights` below `size`.  Starts are drawn from a sample of
    rows by their squared distances; a start ends when its centres rest, and then costs no more.  A cluster that loses
    all rows keeps its centre.  The silhouette is the squared-Euclidean one.  NULL vectors take no part; without rows
    every number is NULL or 0.
    """
    sparse = "term_ids" in rows.columns
    plain = rows.select("term_ids", "weights").filter("term_ids is not null") if sparse else rows.filter("features is not null").select(vector_to_array("features").alias("x"))
    # A task returns a sum per cluster and term, so there are as many tasks as run at once, however many rows there are.
    plain = stage_table(plain, "kmeans").coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    if not sparse:
        first = plain.first()
        size = len(first["x"]) if first else 0
    by_hash = plain.orderBy(F.xxhash64(*plain.columns)).limit(max(max(ks), min(SAMPLE_ROWS, SAMPLE_CELLS // max(1, size)))).toPandas()
    if not len(by_hash):
        return [(k, None, [0] * k, [0.0] * starts) for k in ks], {k: Clusters(np.zeros((k, size or 0))) for k in ks}
    sample = Block(by_hash, size).to_dense()
    fits = [_first_centres(sample, k, np.random.default_rng([seed, k, s])) for k in ks for s in range(starts)]
    moving = list(range(len(fits)))
    for _ in range(rounds):
        for at, found in zip(list(moving), _one_pass(plain, [fits[i] for i in moving], size)):
            full = found.counts > 0
            new = fits[at].copy()
            new[full] = found.sums[full] / found.counts[full, None]
            rested = (((new - fits[at]) ** 2).sum(axis=1) <= tolerance**2).all()
            fits[at] = new
            if rested:
                moving.remove(at)
        if not moving:
            break
    ended = _one_pass(plain, fits, size)
    costs = [float(e.costs.sum()) for e in ended]
    best = [min(range(j * starts, (j + 1) * starts), key=costs.__getitem__) for j in range(len(ks))]
    kept, sums = [fits[b] for b in best], [ended[b] for b in best]
    n = sums[0].counts.sum()
    scores = plain.mapInPandas(_silhouette_pass(kept, sums, size), SUMS).groupBy("cell").agg(F.sum("s").alias("s")).collect()
    score = {r["cell"]: r["s"] / n for r in scores}
    table = [(k, float(score[j]), sorted(int(c) for c in sums[j].counts), costs[j * starts : (j + 1) * starts]) for j, k in enumerate(ks)]
    return table, {k: Clusters(kept[j]) for j, k in enumerate(ks)}
