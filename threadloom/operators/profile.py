"""Profiling: inventories, shares, null counts, ranges and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.scoring import rounded
from threadloom.operators.ranks import order_hash


def inventory(df: DataFrame, author: str, key: str) -> DataFrame:
    """AGG1: rows, distinct authors, rows beyond the first per key."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), F.count_distinct(author).alias("n_authors"), (n - F.count_distinct(key)).alias("n_duplicate_keys")
    )


def value_share(df: DataFrame, *keys: str) -> DataFrame:
    """AGG2, WIN12: count and percentage per value; the total is summed over the small grouped frame."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("_total", total).withColumn("pct", rounded(F.col("n") / F.col("_total") * 100, 2)).drop("_total")


def null_counts(df: DataFrame) -> DataFrame:
    """AGG3: one row per column, from a single pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column_name", "n_nulls")


def author_overlap(df: DataFrame, author: str = "author_id", inbound: str = "inbound") -> DataFrame:
    """AGG4, SET3: sizes of the brand and customer author sets and of their intersection."""
    per_author = df.groupBy(author).agg(F.max(F.col(inbound)).alias("c"), F.max(~F.col(inbound)).alias("b"))
    return per_author.agg(
        F.count_if("b").alias("brand_authors"), F.count_if("c").alias("customer_authors"), F.count_if(F.col("b") & F.col("c")).alias("overlap")
    )


def time_range(df: DataFrame, ts: str) -> DataFrame:
    """AGG5."""
    return df.agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def length_profile(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """AGG6, PRJ8: mean, median and longest text length per group."""
    n = F.char_length(text)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(n), 2).alias("mean_len"), F.median(n).alias("median_len"), F.max(n).alias("max_len")
    )


def top_values(df: DataFrame, key: str, n: int) -> DataFrame:
    """SRT1, SRT2: most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def mode(df: DataFrame, label: str) -> DataFrame:
    """AGG14: the most frequent label, smallest on ties, as one row."""
    return top_values(df.filter(F.col(label).isNotNull()), label, 1).select(F.col(label).alias("majority_label"), "n")


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """SRT4: first n rows by key."""
    return df.orderBy(key).limit(n)


def lowest(df: DataFrame, value: str, tie: str) -> DataFrame:
    """SRT5: the row with the lowest value."""
    return df.orderBy(F.asc_nulls_last(value), tie).limit(1)


def inspect_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SRT6, WIN8: exactly n pseudo-random rows (all when there are fewer), a bounded sort per task."""
    return df.orderBy(order_hash(seed, F.col(key)), key).limit(n)


def share_ratio(sample: DataFrame, corpus: DataFrame, label: str) -> DataFrame:
    """AGG30: label share in a sample against the corpus; ratio 0 where the sample share is 0."""
    pct = lambda df, name: df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(
        label, (F.col("n") * 100 / F.sum("n").over(W.partitionBy(F.lit(0)))).alias(name)
    )
    s, c = pct(sample, "sample_pct"), pct(corpus, "corpus_pct")
    both = s.join(c, label, "left").withColumn("corpus_pct", F.coalesce("corpus_pct", F.lit(0.0)))
    ratio = F.coalesce(F.try_divide(F.col("corpus_pct"), F.col("sample_pct")), F.lit(0.0))
    return both.select(label, rounded(F.col("sample_pct"), 2).alias("sample_pct"), rounded(F.col("corpus_pct"), 2).alias("corpus_pct"), rounded(ratio, 2).alias("ratio"))
