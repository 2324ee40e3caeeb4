"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Equal fingerprints collapse to one.  A tile holds the fingerprints of one pair of population counts (upper and lower
32 bits); a differing bit changes one of the two by one, so tiles whose counts differ by more than the radius in sum
hold no link and are never paired.  Large tiles are split into blocks of bounded size, and a pair of blocks is one
group: numpy exclusive-or and bit counts compare it, after the same test on quarters of the bits has ruled out
sub-tiles.  A group returns a spanning forest of its links, never all pairs, and the forests' components are found by
rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from threadloom.llm.common import raw_texts
from threadloom.llm.components import components
from threadloom.sources.scratch import stage_table

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
BLOCK_ROWS = 262_144  # fingerprints of a tile compared at a time; copies of a fingerprint grow with tile / this
FINE_PAIRS = 4_000_000  # block pairs beyond this are cut into sub-tiles first
HALF_BITS = 32


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint; 0 without words.  A bit is set if it is in over half the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
        n = len(words) - shingle_words + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(shingle_words: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle_words, seed) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int16) for s in (0, 16, 32, 48)], axis=1)


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked nodes in place; `parent` holds roots before and after."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _linked(a: np.ndarray, b: np.ndarray, radius: int, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = max(1, step // max(1, len(b)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        yield i + at, j


def block_forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that span all links between two arrays of distinct fingerprints (or within one: a is b)."""
    nodes = a if a is b else np.concatenate([a, b])
    shift = 0 if a is b else len(a)
    parent = np.arange(len(nodes))
    if len(a) * len(b) <= FINE_PAIRS:
        for i, j in _linked(a, b, radius):
            _unite(parent, i, j + shift)
    else:
        parts = []
        for x in (a, b):
            counts, order = np.unique(_quarters(x), axis=0, return_inverse=True)
            order = order.ravel()
            by = np.argsort(order, kind="stable")
            parts.append((counts, np.split(by, np.cumsum(np.bincount(order))[:-1])))
        (counts_a, rows_a), (counts_b, rows_b) = parts
        for count, rows in zip(counts_a, rows_a):
            near = np.flatnonzero(np.abs(counts_b - count).sum(axis=1) <= radius)
            if len(near):
                other = np.concatenate([rows_b[k] for k in near])
                for i, j in _linked(a[rows], b[other], radius):
                    _unite(parent, rows[i], other[j] + shift)
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _compare(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        a, b = prints[side == 0], prints[side == 1]
        node, root = block_forest(a, a, radius) if pdf["same"].iat[0] else block_forest(a, b, radius)
        return pd.DataFrame({"a": node.view(np.int64), "b": root.view(np.int64)})

    return run


def _half_count(fp: Column, upper: bool) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, HALF_BITS) if upper else fp.bitwiseAND(F.lit((1 << HALF_BITS) - 1)))


def links(prints: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints `fp` within `radius` differing bits."""
    spark = prints.sparkSession
    tiled = prints.select("fp", (_half_count(F.col("fp"), True) * 64 + _half_count(F.col("fp"), False)).alias("tile"))
    sizes = {r["tile"]: r["count"] for r in tiled.groupBy("tile").count().collect()}  # at most 33 x 33 rows
    blocks = {t: -(-n // block_rows) for t, n in sizes.items()}
    near = [
        (t, blocks[t], u, blocks[u])
        for t in blocks
        for high in range(-radius, radius + 1)
        for low in range(abs(high) - radius, radius - abs(high) + 1)
        if (u := t + 64 * high + low) in blocks and (t & 63) + low == u & 63
    ]  # at most 33 x 33 x 25 rows for radius 3
    if not near:
        return spark.createDataFrame([], "a long, b long")
    around = F.broadcast(spark.createDataFrame(near, "tile int, own_blocks int, other int, other_blocks int"))
    spread = (
        tiled.join(around, "tile")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("own_blocks")).cast("int"))
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    )
    numbered = lambda tile, block: F.shiftleft(F.col(tile).cast("long"), 32) + F.col(block)
    own, other = numbered("tile", "block"), numbered("other", "other_block")
    first = own <= other
    pairs = spread.select(
        "fp",
        F.when(first, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        (own == other).alias("same"),
        F.when(first, own).otherwise(other).alias("one"),
        F.when(first, other).otherwise(own).alias("two"),
    )
    return pairs.groupBy("one", "two").applyInPandas(_compare(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most `radius` bits reach, for every row.

    Takes doc_id and text of `docs`; other columns are not read.  NULL, empty and blank texts have fingerprint 0 and
    link like any other.  Repeated rows stay repeated.  A NULL doc_id never is a component's id, unless a component
    has no other.  An empty table gives no rows.
    """
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle_words, seed), "doc_id long, fp long")
    prints = stage_table(prints, "fingerprints")
    of_root = _rooted(prints, radius, block_rows)
    component = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of_root.select("fp", "root").join(component, "root").select("fp", "component_id"), "fp")


def _rooted(prints: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """fp, its component's root fingerprint and its smallest doc_id (least), once for every distinct fingerprint."""
    least = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least-ids")
    roots = components(links(least.select("fp"), radius, block_rows))
    return least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _with_fingerprint(shingle_words: int, seed: int, column: int, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle_words, seed) for t in batch.column(column).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, name])

    return run


def one_of_each(
    docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per component of near-duplicates, that of smallest doc_id (NULL last), then smallest text; all columns
    stay."""
    mark = "x"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    fp, known, key, nth = (mark + c for c in ("fp", "known", "key", "nth"))
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle_words, seed), "doc_id long, fp long")
    of_root = stage_table(_rooted(stage_table(prints, "fingerprints"), radius, block_rows), "roots")
    top = of_root.groupBy("root").agg(F.min("least").alias("top"))
    chosen = of_root.join(top, "root").filter(F.col("least").eqNullSafe(F.col("top")))
    chosen = chosen.select(F.col("fp").alias(fp), F.col("least").isNotNull().alias(known), F.coalesce("least", F.lit(0)).alias(key), F.col("root").alias(mark))
    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    rows = docs.mapInArrow(_with_fingerprint(shingle_words, seed, docs.columns.index("text"), fp), schema)
    number = F.col("doc_id").cast("long")
    rows = rows.withColumns({known: number.isNotNull(), key: F.coalesce(number, F.lit(0))})
    # copies go before the shuffle, one row per fingerprint and id is left
    rows = rows.withColumn(nth, F.row_number().over(W.partitionBy(fp, known, key).orderBy("text"))).filter(F.col(nth) == 1).drop(nth)
    first = W.partitionBy(mark).orderBy("text")
    single = rows.join(chosen, [fp, known, key]).withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1)
    return single.select(*docs.columns)
