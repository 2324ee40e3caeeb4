"""Periodic runs in texts: stretches of words that repeat with a fixed distance, and the texts without the repeats.

At each dyadic scale, texts are cut into aligned blocks of 2, 4, 8, ... words.  A run of period q has, from its first
word, at least max(q, 12 - q) words that come again q words later, so it covers a whole block of the scale whose
distances hold q.  For every block, the sums of squared differences to the window behind it are one correlation, done
exactly by number-theoretic transforms modulo as many primes as the largest possible sum needs; zeros are occurrences.
A zero's distance seeds a stretch: blocks in a row with the same distance are joined, the ends are extended word by
word, by less than a block, and a stretch of two periods or more is a run.

Two exact rules keep the work near linear.  A block is left out when one of its words does not come again within the
scale's distances (no zero is possible), and when its whole window lies inside a run already found whose period is no
longer than the block (all its zeros lead to that run).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import spans_of

LEAST_WORDS = 12
LEAST_PERIODS = 2
#: Primes with roots of unity of order 2**27, 2**26, 2**25: transforms of so many words, for texts of up to 2**25 words.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
CELLS = 1 << 20  # numbers that a block of transforms holds at a time
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Transform:
    """Number-theoretic transforms of rows of `size` numbers modulo a prime below 2**31."""

    def __init__(self, size: int, prime: int, generator: int):
        self.size, self.prime = size, np.uint64(prime)
        root = pow(generator, (prime - 1) // size, prime)
        self.forward, self.backward = self._powers(root), self._powers(pow(root, -1, prime))
        self.shrink = np.uint64(pow(size, -1, prime))

    def _powers(self, root: int) -> np.ndarray:
        """The first size/2 powers, by doubling."""
        out = np.ones(max(1, self.size // 2), np.uint64)
        have = 1
        while have < len(out):
            out[have : 2 * have] = out[: min(have, len(out) - have)] * np.uint64(pow(root, have, int(self.prime))) % self.prime
            have *= 2
        return out

    def _run(self, rows: np.ndarray, powers: np.ndarray) -> np.ndarray:
        """Self-sorting butterflies: each round halves the length of a transform and doubles their number."""
        n, many = self.size, 1
        while n > 1:
            half = n // 2
            parts = rows.reshape(len(rows), 2, half, many)
            a, b = parts[:, 0], parts[:, 1]
            out = np.empty((len(rows), half, 2, many), np.uint64)
            out[:, :, 0] = (a + b) % self.prime
            out[:, :, 1] = (a + self.prime - b) % self.prime * powers[::many][:half, None] % self.prime
            rows, n, many = out.reshape(len(rows), self.size), half, 2 * many
        return rows

    def correlate(self, block: np.ndarray, window: np.ndarray) -> np.ndarray:
        """sum_j block[j] * window[d + j] at every d, cyclic, for each row."""
        reversed_block = np.roll(block[:, ::-1], 1, axis=1)
        product = self._run(reversed_block % self.prime, self.forward) * self._run(window % self.prime, self.forward) % self.prime
        return self._run(product, self.backward) * self.shrink % self.prime


_transforms: dict[tuple[int, int], Transform] = {}


def _transform(size: int, prime: int, generator: int) -> Transform:
    if (size, prime) not in _transforms:
        _transforms[size, prime] = Transform(size, prime, generator)
    return _transforms[size, prime]


def zero_mismatches(x: np.ndarray, starts: np.ndarray, block: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all occurrences of x[start : start + block] at least..most words further on.

    `x` are numbers from 0.  Behind its end nothing matches.
    """
    offsets = most - least + 1
    size = 1 << int(np.ceil(np.log2(offsets + block - 1)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    high = int(x.max(initial=0)) + 1
    bound, primes, product = block * high * high, [], 1
    for p in PRIMES:
        if product <= bound:
            primes.append(p)
            product *= p[0]
    if product <= bound:
        raise ValueError(f"words of {block} numbers up to {high} need more primes")
    for lo in range(0, len(starts), max(1, CELLS // size)):
        at = starts[lo : lo + max(1, CELLS // size)]
        mine = x[at[:, None] + np.arange(block)]
        index = at[:, None] + least + np.arange(offsets + block - 1)
        there = np.where(index < len(x), x[np.minimum(index, len(x) - 1)], high)
        zero = np.ones((len(at), offsets), bool)
        for prime, generator in primes:
            p = np.uint64(prime)
            padded = lambda rows: np.pad(rows, ((0, 0), (0, size - rows.shape[1]))).astype(np.uint64)
            both = _transform(size, prime, generator).correlate(padded(mine), padded(there))[:, :offsets]
            square = there.astype(np.uint64) % p
            sums = np.cumsum(square * square % p, axis=1, dtype=np.uint64)  # below 2**25 terms of 31 bits
            sums = np.concatenate([np.zeros((len(at), 1), np.uint64), sums], axis=1)
            windows = (sums[:, block : block + offsets] - sums[:, :offsets]) % p
            own = mine.astype(np.uint64) % p
            own = (own * own % p).sum(axis=1, dtype=np.uint64)[:, None] % p
            zero &= (windows + own) % p == both * np.uint64(2) % p
        row, offset = np.nonzero(zero)
        found.append((at[row], least + offset))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _extend(x: np.ndarray, left: np.ndarray, right: np.ndarray, distance: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the words i with x[i] == x[i + distance] around [left, right), at most a block further."""
    for step in (-1, 1):
        edge = left - 1 if step < 0 else right.copy()
        live = np.arange(len(edge))
        for _ in range(block):
            i, d = edge[live], distance[live]
            inside = (i >= 0) & (i + d < len(x))
            same = np.zeros(len(live), bool)
            same[inside] = x[i[inside]] == x[i[inside] + d[inside]]
            live = live[same]
            if not len(live):
                break
            edge[live] += step
        left, right = (edge + 1, right) if step < 0 else (left, edge)
    return left, right


def _inside_runs(first: np.ndarray, last: np.ndarray, period: np.ndarray, runs: np.ndarray, multiple: bool) -> np.ndarray:
    """Which [first, last) lie in a run whose period is at most `period` (divides it, if `multiple`)."""
    out = np.zeros(len(first), bool)
    order = np.argsort(first, kind="stable")
    by_first = first[order]
    for start, end, q in runs:
        lo, hi = np.searchsorted(by_first, start), np.searchsorted(by_first, end)
        mine = order[lo:hi]
        good = last[mine] <= end
        good &= period[mine] % q == 0 if multiple else period[mine] >= q
        out[mine[good]] = True
    return out


def find_runs(x: np.ndarray, least_words: int = LEAST_WORDS) -> np.ndarray:
    """(start, end, period) rows of all runs of the numbers `x`, by start, then period.

    A run is a stretch of smallest period q, of max(least_words, 2q) numbers or more, that cannot be made longer.
    """
    n = len(x)
    none = np.zeros((0, 3), np.int64)
    if n < least_words:
        return none
    order = np.argsort(x, kind="stable")
    again = np.full(n, n, np.int64)  # words until the same one comes again
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs = none
    block = 2
    while True:
        # Block 2 has the periods whose stretches may hold no block of 4; from 4 on, periods of 2 blocks and more.
        least, most = (1, 6) if block == 2 else (max(7, 2 * block - 1), 4 * block - 2)
        if least > n // LEAST_PERIODS:
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        starts = np.arange(0, n - block + 1, block)
        farthest = np.maximum.reduceat(again[: len(starts) * block], starts) if len(starts) else starts
        starts = starts[farthest <= most]
        long = runs[runs[:, 1] - runs[:, 0] >= block + least]
        if len(starts) and len(long):
            starts = starts[~_inside_runs(starts, np.minimum(starts + block + most, n), np.full(len(starts), block), long, False)]
        if len(starts):
            at, distance = zero_mismatches(x, starts, block, least, most)
            if len(long) and len(at):
                new = ~_inside_runs(at, at + distance + block, distance, long, True)
                at, distance = at[new], distance[new]
            if len(at):
                by = np.lexsort((at, distance))
                at, distance = at[by], distance[by]
                breaks = np.flatnonzero((distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + block)) + 1
                left, right = at[np.r_[0, breaks]], at[np.r_[breaks - 1, len(at) - 1]] + block
                d = distance[np.r_[0, breaks]]
                left, right = _extend(x, left, right, d, block)
                end = right + d
                good = end - left >= np.maximum(least_words, LEAST_PERIODS * d)
                new = np.stack([left[good], end[good], d[good]], axis=1)
                every = np.concatenate([runs, new])
                every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
                keep = np.ones(len(every), bool)  # of one stretch only the smallest period
                keep[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
                runs = every[keep]
        block *= 2


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run covers behind its first period."""
    change = np.zeros(n + 1, np.int64)
    if len(runs):
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number, by first appearance."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _scan(least_words: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo, hi in spans_of(texts.to_pylist()):
                counts, runs, collapsed = [], [], []
                for text in texts[lo:hi].to_pylist():
                    words = (text or b"").split()
                    found = find_runs(numbered(words), least_words)
                    counts.append(len(words))
                    runs.append([{"start": int(s), "length": int(e - s), "period": int(q)} for s, e, q in found])
                    kept = [w for w, k in zip(words, kept_words(len(words), found)) if k] if len(found) else words
                    collapsed.append(b" ".join(kept).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def scan(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row.

    Takes doc_id and text; other columns are not read.  Words are what is left between \\x20 and \\x09-\\x0D.  A NULL text
    is an empty one: no words, no runs, an empty collapsed text.  Every row gives one row, repeated rows and rows without
    an id too; an empty table gives none.  A text is searched whole, in one task; memory is bounded by its own length,
    which may be up to 2**25 words (the transforms' largest size).
    The collapsed text is the words outside every run and those of each run's first period, joined by one space.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan(least_words), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; NULL without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return F.when(best.isNotNull(), F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period")))


def runs_digest(runs: Column) -> Column:
    """sha256 of the runs' `start,length,period` lines."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.sha2(F.array_join(F.transform(runs, line), ""), 256)


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in every tenth document (by crc32 of its id) the words from some place on go round in a loop.

    With h = crc32 of the decimal id and g = h / 10, a document with h divisible by 10 and n words has each word i >= a
    replaced by word a + (i - a) % p, a = g % n, p = 1 + (n - a) / (3 + g % 8).  Others, and those without words or id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(h / F.lit(10))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
    n = F.size("_words").cast("long")
    chosen = chosen.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    chosen = chosen.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    looped = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))
