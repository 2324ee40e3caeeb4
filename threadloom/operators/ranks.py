"""Exact order statistics without a global window.

Ranks, medians and fold numbers need the position of a row in a total order.  A window over all rows, or
over a label that holds a third of them, would sort that group in one task.  Here the order is cut into
buckets, the bucket totals (a small frame) are summed up, and only rows inside one bucket are windowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.sources.scratch import stage_table

BUCKET_ROWS = 200_000  # about so many rows are sorted by one task


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the keys of the left side stay."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_right_{k}"])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def order_hash(seed: int | str, key: Column) -> Column:
    """The pseudo-random order every sampler uses: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def position_by_hash(df: DataFrame, by: Sequence[str], hash_col: str, tie: str, out: str = "position", digits: int | None = None) -> DataFrame:
    """1-based position of every row inside its group, ordered by a hex hash, then `tie`; NULL is a group like any other.

    The leading hex digits of the hash cut each group into 16**digits even buckets, so a hot group is spread over all
    of them; their number follows the number of rows.
    """
    if digits is None:
        rows = df.count()
        digits = 1
        while rows > BUCKET_ROWS * 16**digits:
            digits += 1
    cut = df.withColumn("_bucket", F.substring(hash_col, 1, digits))
    sizes = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, "_bucket").orderBy(hash_col, tie)
    return (
        join_null_safe(cut.withColumn("_inside", F.row_number().over(inside)), offsets, [*by, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def in_ranges(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows in one total order, written once: `_part` numbers the ranges, `_at` a row's place in its range from 0.

    Ranges are cut at sampled values, so none of them holds the whole of a large group; rows equal in all of `order`
    share a range.  Everything read from it later sees the same ranges, also after an executor is lost.
    """
    dealt = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("_id", F.monotonically_increasing_id())  # the range's number, then 33 bits of place
    return stage_table(
        numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "ranges"
    )


def _range_offsets(placed: DataFrame, by: Sequence[str], *, n: Column) -> DataFrame:
    """Per (group, range): the group's total, what its earlier ranges hold, and its first place in the range.

    A group has one row per range it reaches into, so the window is over ranges, not over rows.
    """
    sums = placed.groupBy(*by, "_part").agg(n.alias("_n"), F.min("_at").alias("_first"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("total"))


def position_by_range(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "position", partitions: int | None = None) -> DataFrame:
    """0-based position of every row inside its group in the order of `order`, and the group's `total`; NULLs come first."""
    placed = in_ranges(df, [*by, *order], partitions)
    offsets = _range_offsets(placed, by, n=F.count(F.lit(1)))
    return (
        join_null_safe(placed, offsets, [*by, "_part"])
        .withColumn(out, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_part", "_at", "_first", "_before")
    )


def value_positions(
    df: DataFrame, by: Sequence[str], value: str, buckets: int | None = None, weight: str | None = None
) -> DataFrame:
    """One row per (group, value): `n` rows, `before` rows with a smaller value, `total` rows in the group.

    Rows are counted per value first, so repeats combine before the shuffle.  The counts are dealt into ranges
    (`buckets` of them, or as many as a shuffle has), each is summed up by itself, and the sums of the ranges before are
    added: no group is one task's.  NULL values are left out, NULL groups are not.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    placed = in_ranges(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n")), [*by, value], buckets)
    inside = W.partitionBy(*by, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return join_null_safe(summed, _range_offsets(placed, by, n=F.sum("n")), [*by, "_part"]).select(
        *by, value, "n", (F.col("_before") + F.col("_inside")).alias("before"), "total"
    )


def average_ranks(positions: DataFrame, out: str = "rank") -> DataFrame:
    """WIN9: tied values share the mean of their ranks."""
    return positions.withColumn(out, F.col("before") + (F.col("n") + 1) / F.lit(2.0))


def quantiles_from(positions: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each group from `value_positions`; two rows per quantile are kept."""
    low = lambda p: F.floor(F.lit(p) * (F.col("total") - 1))
    high = lambda p: F.ceil(F.lit(p) * (F.col("total") - 1))
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    aggs = []
    for name, p in probs.items():
        aggs += [
            F.max(F.when(holds(low(p)), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when(holds(high(p)), F.col(value))).alias(f"_{name}_hi"),
        ]
    out = positions.groupBy(*by).agg(F.max("total").alias("total"), *aggs)
    cols = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*by, "total", *cols)


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Exact quantiles per group for values with unbounded range (times, amounts).

    For values with a small range (text lengths, scores) the built-in `median` is enough: its buffer holds one
    entry per distinct value.
    """
    return quantiles_from(value_positions(df, by, value, buckets), by, value, probs)
