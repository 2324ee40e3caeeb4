"""Dedup, deterministic samples, folds and splits.

Every draw is ordered by md5(seed:id), so it repeats on any cluster and any partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.lexicon import mentions, multi_issue, sarcasm_risk
from threadloom.functions.text import normal_form, text_key
from threadloom.operators.ranks import join_null_safe, order_hash, position_by_hash


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """WIN1: of the rows with equal key the one with the smallest `order`.

    The window is limited to its first row, and Spark applies that limit in every task before the shuffle, so
    a text copied a billion times sends one row per task.  The key is a digest, not the text.
    """
    w = W.partitionBy("_key").orderBy(order)
    return df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_key", "_rn")


def dedup_exact(df: DataFrame, text: str, order: str) -> DataFrame:
    """WIN1 on the raw text."""
    return keep_first(df, text_key(F.col(text)), order)


def with_normal_key(df: DataFrame, text: str, min_chars: int = 0, out: str = "norm_key") -> DataFrame:
    """FLT6: adds the digest of the normal form; rows whose normal form is shorter are dropped.

    `explode` of a one-element array computes the normal form exactly once per row; as a plain column it would
    be repeated in every filter the optimiser pushes towards the scan.
    """
    norm = F.filter(F.array(normal_form(F.col(text))), lambda n: F.char_length(n) >= min_chars)
    return df.select("*", F.explode(F.transform(norm, text_key)).alias(out))


def dedup_normalized(df: DataFrame, text: str, order: str, min_chars: int = 3) -> DataFrame:
    """WIN1, FLT6 on the normal form; shorter normal forms are dropped.

    Equal raw texts have equal normal forms, so the raw pass that may precede it changes nothing.
    """
    return keep_first(with_normal_key(df, text, min_chars), F.col("norm_key"), order).drop("norm_key")


def random_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """WIN8: exactly n rows; each task keeps its own n first, so there is no full sort."""
    return df.orderBy(order_hash(seed, F.col(key)), key).limit(n)


def kfold(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """WIN10: stratified fold number 0..folds-1; rows with a NULL label are a stratum of their own."""
    placed = position_by_hash(df.withColumn("_h", order_hash(seed, F.col(key))), [label], "_h", key, "_pos")
    return placed.withColumn("fold", F.pmod(F.col("_pos") - 1, F.lit(folds)).cast("int")).drop("_h", "_pos")


def dev_test_split(df: DataFrame, stratum: str, key: str, dev_share: float = 0.6, seed: int = 42) -> DataFrame:
    """WIN11: the first share of each stratum in hash order is dev, the rest test; NULL is a stratum like any other."""
    placed = position_by_hash(df.withColumn("_h", order_hash(seed, F.col(key))), [stratum], "_h", key, "_pos")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    is_dev = F.col("_pos") <= F.round(F.col("_size") * dev_share)
    return join_null_safe(placed, sizes, [stratum]).withColumn("split", F.when(is_dev, "dev").otherwise("test")).drop("_h", "_pos", "_size")


def quotas(df: DataFrame, stratum: str, strata: Sequence[str], target: int, floor: int = 10) -> DataFrame:
    """WIN5: floor per stratum plus a proportional share of what is left, residue to the largest stratum."""
    pool = target - floor * len(strata)
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    all_strata = df.sparkSession.createDataFrame([(s,) for s in strata], f"{stratum} string")
    total = counts.agg(F.sum("n")).scalar()
    base = all_strata.join(counts, stratum, "left").select(
        stratum, F.coalesce("n", F.lit(0)).alias("n"),
        (F.lit(floor) + F.bround(F.coalesce(F.col("n") / total, F.lit(0.0)) * pool).cast("int")).alias("quota"),
    )
    # A frame of one row per stratum: the window over it is a handful of rows.
    everything = W.partitionBy(F.lit(0))
    top = F.row_number().over(everything.orderBy(F.desc("n"), stratum))
    residue = F.lit(target) - F.sum("quota").over(everything)
    return base.withColumn("_residue", residue).withColumn("_top", top).select(
        stratum, "n", (F.col("quota") + F.when(F.col("_top") == 1, F.col("_residue")).otherwise(0)).alias("quota")
    )


def stratified_sample(
    df: DataFrame, stratum: str, key: str, strata: Sequence[str], target: int, floor: int = 10, seed: int = 42
) -> DataFrame:
    """WIN5: the first `quota` rows of each stratum in hash order.

    Positions come from hash buckets, so that no task sorts a whole stratum, whatever the target.
    """
    ranked = position_by_hash(df.withColumn("_h", order_hash(seed, F.col(key))), [stratum], "_h", key, "_rn")
    q = quotas(df, stratum, strata, target, floor).select(stratum, "quota")
    return ranked.join(F.broadcast(q), stratum).filter(F.col("_rn") <= F.col("quota")).drop("_h", "_rn", "quota")


def hard_rules(
    text: str = "customer_text",
    followup: str = "followup_text",
    has_followup: str = "has_followup",
    confidence: str = "pseudo_confidence",
    frustration: Sequence[str] = tuple(V.FRUSTRATION_WORDS),
    praise: Sequence[str] = tuple(V.PRAISE_WORDS),
    topics: Mapping[str, Sequence[str]] = V.TOPIC_WORDS,
    min_chars: int = 180,
    max_confidence: float = V.ESCALATION_CONFIDENCE,
) -> dict[str, Column]:
    """The four hard-case rules in priority order (FLT2, FLT7, FLT8, FLT9)."""
    return {
        "hard_a": F.col(has_followup) & mentions(F.col(followup), frustration),
        "hard_b": multi_issue(F.col(text), topics, min_chars),
        "hard_c": F.col(confidence) <= max_confidence,
        "hard_d": sarcasm_risk(F.col(text), praise, frustration),
    }


def hard_tail(df: DataFrame, key: str, rules: Mapping[str, Column], per_rule: int = 15, seed: int = 42) -> DataFrame:
    """WIN6, JON10, FLT8: up to `per_rule` ids per rule, rules in priority order, no id twice; columns key, sample_layer.

    One scan: earlier rules can take at most per_rule ids each, so the first per_rule * position ids of a rule
    in hash order are enough to settle it.  That bounded list becomes one row of arrays, where each rule takes
    what the rules before it left.
    """
    names = list(rules)
    flagged = df.select(
        F.col(key).alias("id"), order_hash(seed, F.col(key)).alias("h"),
        F.explode(F.array_compact(F.array(*[F.when(rules[n], F.lit(n)) for n in names]))).alias("rule"),
    )
    enough = per_rule * len(names)
    w = W.partitionBy("rule").orderBy("h", "id")
    short = flagged.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= enough)
    lists = short.agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("rule") == n, F.struct("rn", "id")))), lambda x: x["id"]
            ).alias(n)
            for n in names
        ]
    )
    taken = None
    for n in names:
        left = F.col(n) if taken is None else F.array_except(n, taken)
        lists = lists.withColumn(n, F.slice(left, 1, per_rule))
        taken = F.concat(*[F.col(m) for m in names[: names.index(n) + 1]])
    layers = F.array(*[F.struct(F.lit(n).alias("sample_layer"), F.col(n).alias("ids")) for n in names])
    return lists.select(F.explode(layers).alias("x")).select("x.sample_layer", F.explode("x.ids").alias(key)).select(key, "sample_layer")


def golden_sample(
    corpus: DataFrame,
    key: str,
    stratum: str,
    rules: Mapping[str, Column],
    strata: Sequence[str],
    n: int = 200,
    per_rule: int = 15,
    floor: int = 10,
    seed: int = 42,
) -> DataFrame:
    """WIN7, JON17, SET4: hard layers, then the stratified base from the rest, shuffled and numbered 1..n.

    The base size depends on how many hard rows were found, so that small list is settled first; it also
    keeps the later reads of the corpus to one anti join against at most per_rule * rules ids.
    """
    from threadloom.sources.scratch import cut_lineage

    hard = cut_lineage(hard_tail(corpus, key, rules, per_rule, seed))
    rest = corpus.join(F.broadcast(hard), key, "left_anti")
    base = stratified_sample(rest, stratum, key, strata, n - hard.count(), floor, seed).withColumn("sample_layer", F.lit("base"))
    picked = corpus.join(F.broadcast(hard), key).unionByName(base)
    # At most n rows are left here.
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order_hash(f"{seed}:order", F.col(key)), key))
    return picked.withColumn("golden_id", number)
