"""The silhouette by plain Euclidean distances, exact, for any number of assignments of the same rows at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_ROWS = 32_768
TILE_CELLS = 4_000_000  # numbers of the vectors, or of the sums, of a tile
LEAST_ROWS = 1_024  # of a tile that is made smaller so that every core has pairs of tiles
PAIRS_PER_CORE = 4
BLOCK = 256  # rows and columns of the distances that are held at a time; they stay in a core's cache
PACKED = 1_024  # numbers of the vectors, or of the sums, that travel as one row
NEAR = 1e-7  # below this share of the squared lengths, a squared distance is taken from the differences


class _Tile:
    """Rows with what their products need: the product of `left` and `right` rows is their squared distance."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, n: np.ndarray, begin: np.ndarray):
        self.x, self.lengths = x, (x**2).sum(axis=1)
        one = np.ones(len(x))
        self.left = np.column_stack([-2 * x, self.lengths, one])
        self.right = np.column_stack([x, one, self.lengths])
        self.members = _members(codes, n, begin)
        self.sums = np.zeros(self.members.shape)


def _members(codes: np.ndarray, n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows by clusters of all assignments: how many rows of the table a row stands for, in its own clusters."""
    out = np.zeros((len(n), begin[-1]))
    for f, lo in enumerate(begin[:-1]):
        out[np.arange(len(n)), lo + codes[:, f]] = n
    return out


def _meet(a: _Tile, b: _Tile) -> None:
    """Adds to the sums of each row of `a` its distances to the clusters' rows in `b`, and the other way round; a tile meets
    itself once."""
    for lo in range(0, len(a.x), BLOCK):
        here = slice(lo, lo + BLOCK)
        for at in range(0, len(b.x), BLOCK):
            there = slice(at, at + BLOCK)
            far = a.left[here] @ b.right[there].T
            near = NEAR * (a.lengths[here].max() + b.lengths[there].max())
            if far.min() <= near:
                i, j = np.nonzero(far <= near)
                cancelled = far[i, j] <= NEAR * (a.lengths[here][i] + b.lengths[there][j])
                i, j = i[cancelled], j[cancelled]
                step = max(1, BLOCK**2 // max(1, a.x.shape[1]))
                for k in range(0, len(i), step):
                    part = i[k : k + step], j[k : k + step]
                    far[part] = ((a.x[here][part[0]] - b.x[there][part[1]]) ** 2).sum(axis=1)
            np.sqrt(far, out=far)
            a.sums[here] += far @ b.members[there]
            if a is not b:
                b.sums[there] += far.T @ a.members[here]


def _scores(sums: np.ndarray, codes: np.ndarray, sizes: list[np.ndarray], begin: np.ndarray) -> np.ndarray:
    out = np.full(codes.shape, np.nan)
    row = np.arange(len(codes))
    for f, size in enumerate(sizes):
        if len(size) < 2:
            continue
        total, own = sums[:, begin[f] : begin[f + 1]], codes[:, f]
        mine = total[row, own] / np.maximum(size[own] - 1, 1)
        others = total / size
        others[row, own] = np.inf
        other = others.min(axis=1)
        most = np.maximum(mine, other)
        out[:, f] = np.where((size[own] > 1) & (most > 0), (other - mine) / np.where(most > 0, most, 1), 0.0)
    return out


def _lists(values: np.ndarray, lists: int, mask: np.ndarray | None = None) -> pa.Array:
    """The values as so many lists of the same length."""
    flat = pa.array(values.ravel(), mask=None if mask is None else mask.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(lists + 1, dtype=np.int32) * (values.size // max(1, lists))), flat)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The values of a column, or of all lists of a column."""
    values = batch.column(name)
    return (values.flatten() if pa.types.is_list(values.type) else values).to_numpy(zero_copy_only=False)


def _packed(rows: int, tile: int, slot: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of `rows` rows of a tile, each as one row of lists."""
    for at in (slice(lo, lo + rows) for lo in range(0, len(slot), rows)):
        part = {"slot": slot[at].astype(np.int32), **{k: v[at] for k, v in columns.items()}}
        yield pa.RecordBatch.from_pydict({"tile": pa.array([tile], pa.int32()), **{k: _lists(v, 1) for k, v in part.items()}})


def _together(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if len(held) == most:
            yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]


VECTORS = pa.schema([("tile", pa.int32()), ("slot", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("codes", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
SUMS = pa.schema([("tile", pa.int32()), ("slot", pa.list_(pa.int32())), ("sums", pa.list_(pa.float64()))])


def _pack_pass(length: int, assignments: int):
    """Rows of the same tile as lists, some thousand numbers in a row."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, slot, n = (_column(batch, c) for c in ("tile", "slot", "n"))
            x, codes = _column(batch, "x").reshape(len(n), length), _column(batch, "codes").reshape(len(n), assignments).astype(np.int32)
            for t in np.unique(tile):
                of = tile == t
                yield from _packed(max(1, PACKED // max(1, length)), t, slot[of], x=x[of], codes=codes[of], n=n[of])

    return lambda batches: _together(packs(batches), VECTORS)


def _pair_pass(length: int, begin: np.ndarray):
    """A partition has the rows of one pair of tiles; of each row there the sums of distances to the other tile's."""
    width = max(1, int(begin[-1]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        pairs: set[int] = set()
        for batch in batches:
            pairs.update(_column(batch, "pair").tolist())
            tile, many = _column(batch, "tile"), np.diff(batch.column("slot").offsets.to_numpy())
            of, slot, n = np.repeat(tile, many), _column(batch, "slot"), _column(batch, "n")
            x, codes = _column(batch, "x").reshape(len(n), length), _column(batch, "codes").reshape(len(n), len(begin) - 1)
            for t in np.unique(tile):
                held.setdefault(int(t), []).append(tuple(v[of == t] for v in (slot, x, codes, n)))
        if len(pairs) > 1:
            raise ValueError(f"a partition has {len(pairs)} pairs of tiles")
        slots, tiles = {}, {}
        for t in sorted(held):
            slots[t], *rows = (np.concatenate(v) for v in zip(*held.pop(t)))
            tiles[t] = _Tile(*rows, begin)
        if tiles:
            _meet(tiles[min(tiles)], tiles[max(tiles)])
        for t, of in tiles.items():
            yield from _packed(max(1, PACKED // width), t, slots[t], sums=of.sums)

    return lambda batches: _together(sums(batches), SUMS)


def _score_pass(length: int, sizes: list[np.ndarray], rows: int):
    """A partition has the rows of one tile and their sums of all pairs that it is in."""
    begin = np.cumsum([0, *map(len, sizes)])
    width = max(1, int(begin[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, there = np.zeros((rows, width)), np.zeros(rows, bool)
        x, codes, n = np.zeros((rows, length)), np.zeros((rows, len(sizes)), np.int32), np.zeros(rows, np.int64)
        seen: set[int] = set()
        for batch in batches:
            seen.update(_column(batch, "tile").tolist())
            if len(seen) > 1:
                raise ValueError(f"a partition has {len(seen)} tiles")
            many = np.diff(batch.column("slot").offsets.to_numpy())
            summed = np.repeat(_column(batch, "summed"), many)
            slot = _column(batch, "slot")
            if summed.any():
                np.add.at(total, slot[summed], _column(batch, "sums").reshape(-1, width))
            own = slot[~summed]
            if len(own):
                there[own], n[own] = True, _column(batch, "n")
                x[own], codes[own] = _column(batch, "x").reshape(len(own), length), _column(batch, "codes").reshape(len(own), len(sizes))
        at = np.flatnonzero(there)
        for lo in range(0, len(at), step := max(1, 16 * PACKED // max(1, length))):
            of = at[lo : lo + step]
            score = _scores(total[of], codes[of], sizes, begin)
            yield pa.RecordBatch.from_pydict({"x": _lists(x[of], len(of)), "codes": _lists(codes[of], len(of)), "n": pa.array(n[of]), "scores": _lists(score, len(of), np.isnan(score))})

    return run


def silhouettes(rows: DataFrame, vector: str, clusters: Sequence[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """CLU2: (x, clusters, n, scores) per distinct vector and assignment: the `clusters` as strings in the order given,
    the number of rows, and their silhouette in each assignment.

    Equal rows are one with a number.  The rows lie in tiles of `tile_rows` at most, fewer where that leaves cores
    without work; a task holds one pair of tiles and takes each distance once, for both rows, so no pair leaves it:
    rows^2 / 2 x length products and rows^2 / `tile_rows` shuffled copies, whatever the number of assignments.  The
    driver holds the sizes of the clusters.  A row alone in its cluster has 0, as has one without any distance; with a
    single cluster the score is NULL.  Rows with a NULL cluster, a NULL vector or a component that is NULL or not
    finite take no part.  Vectors of different length are an error.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    plain = rows.select(x.alias("x"), F.array(*[F.col(c).cast("string") for c in clusters]).alias("clusters"))
    usable = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.forall("clusters", lambda c: c.isNotNull())
    counted = plain.filter(usable).groupBy("x", "clusters").agg(F.count(F.lit(1)).alias("n"))
    distinct = stage_table(counted.withColumn("id", F.monotonically_increasing_id()), "silhouette")
    facts = distinct.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if facts["low"] != facts["high"]:
        raise ValueError(f"vectors of {facts['low']} to {facts['high']} numbers have no distance")
    counted = distinct.select("n", F.posexplode("clusters").alias("f", "c")).groupBy("f", "c").agg(F.sum("n").alias("n")).collect()
    index: list[dict[str, int]] = [{} for _ in clusters]
    sizes: list[list[int]] = [[] for _ in clusters]
    for r in sorted(counted, key=lambda r: (r["f"], r["c"])):
        index[r["f"]][r["c"]] = len(sizes[r["f"]])
        sizes[r["f"]].append(r["n"])
    length, n_rows, begin = facts["low"] or 0, facts["rows"], np.cumsum([0, *map(len, sizes)])
    # A pair of tiles is a task: t tiles have t (t + 1) / 2.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    spread = max(LEAST_ROWS, int(n_rows / (2 * PAIRS_PER_CORE * cores) ** 0.5))
    per_tile = max(1, min(tile_rows, spread, TILE_CELLS // max(1, length, int(begin[-1]))))
    tiles = max(1, -(-n_rows // per_tile))
    # Rows are numbered by the task that wrote them and their place there, so tiles have the same size.
    part = F.shiftright("id", 33)
    written = sorted((r["part"], r["n"]) for r in distinct.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in written)]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, at) for (p, _), at in zip(written, before)], "part long, start long")
    known = [F.array(*[F.lit(c) for c in of]) if of else F.array().cast("array<string>") for of in index]
    coded = distinct.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1))
    coded = coded.select(
        F.floor(F.col("number") / per_tile).cast("int").alias("tile"), (F.col("number") % per_tile).cast("int").alias("slot"), "x", "n",
        F.array(*[(F.array_position(k, F.get("clusters", F.lit(f))) - 1).cast("int") for f, k in enumerate(known)]).alias("codes"),
    )
    packed = stage_table(coded.mapInArrow(_pack_pass(length, len(clusters)), "tile int, slot array<int>, x array<double>, codes array<int>, n array<long>"), "silhouette-tiles")
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.withColumn("pair", (high.cast("long") * (high + 1) / 2 + low).cast("int")).drop("other")
    dealt = dealt.repartitionById(tiles * (tiles + 1) // 2, F.col("pair"))
    sums = dealt.mapInArrow(_pair_pass(length, begin), "tile int, slot array<int>, sums array<double>")
    both = packed.withColumns({"sums": F.lit(None).cast("array<double>"), "summed": F.lit(False)}).unionByName(sums.withColumn("summed", F.lit(True)), allowMissingColumns=True)
    found = both.repartitionById(tiles, F.col("tile")).mapInArrow(
        _score_pass(length, [np.array(s, float) for s in sizes], per_tile), "x array<double>, codes array<int>, n long, scores array<double>"
    )
    return found.select("x", F.array(*[F.get(k, F.get("codes", F.lit(f))) for f, k in enumerate(known)]).alias("clusters"), "n", "scores")


def plain_silhouette(rows: DataFrame, vector: str, clusters: Sequence[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """CLU2: (assignment, cluster, n, silhouette): the mean of the rows of every cluster, and of all rows where `cluster` is NULL."""
    each = silhouettes(rows, vector, clusters, tile_rows)
    names = F.array(*[F.lit(c) for c in clusters])
    flat = each.select("n", F.explode(F.arrays_zip(names.alias("a"), F.col("clusters").alias("c"), F.col("scores").alias("s"))).alias("e"))
    flat = flat.select(F.col("e.a").alias("assignment"), F.col("e.c").alias("cluster"), "n", (F.col("e.s") * F.col("n")).alias("s"))
    mean = [F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette")]
    return flat.rollup("assignment", "cluster").agg(*mean).filter("assignment is not null").select("assignment", "cluster", "n", "silhouette")
