"""Classification, escalation, routing and score metrics over a run frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.scoring import low_score, rounded


PIVOT_ROWS = 1_000_000  # rows that a task puts side by side


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def _cells(df: DataFrame, gold: str, pred: str, by: Sequence[str]) -> DataFrame:
    # Everything below works on these counts: at most labels x labels rows per group.
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, gold: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """AGG15: one row per (gold, predicted) of the given labels, zero where none."""
    names = F.array(*[F.lit(x) for x in labels])
    grid = df.sparkSession.range(1).select(F.explode(names).alias("gold")).select("gold", F.explode(names).alias("pred"))
    counts = _cells(df, gold, pred, [])
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, gold: str, pred: str, by: Sequence[str] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """AGG16: precision, recall, F1, support per label; zero on zero division.

    Without `labels` the labels are those that occur as gold or predicted; with them, exactly these.
    """
    cells = _cells(df, gold, pred, by)
    side = F.explode(
        F.array(
            F.struct(F.col("gold").alias("label"), F.col("n").alias("gold_n"), F.lit(0).alias("pred_n"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("pred").alias("label"), F.lit(0).alias("gold_n"), F.col("n").alias("pred_n"), F.lit(0).alias("tp")),
        )
    ).alias("x")
    per = cells.select(*by, side).groupBy(*by, "x.label").agg(
        F.sum("x.gold_n").alias("support"), F.sum("x.pred_n").alias("predicted"), F.sum("x.tp").alias("tp")
    )
    if labels is not None:
        wanted = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
        frame = df.select(*by).distinct().select(*by, wanted) if by else df.sparkSession.range(1).select(wanted)
        per = frame.join(per, [*by, "label"], "left").fillna(0, ["support", "predicted", "tp"])
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return per.select(*by, "label", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), "support", "predicted", "tp")


def macro_scores(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG17: macro-F1 over labels present, support-weighted F1 and accuracy, 4 dp."""
    rep = class_report(df, gold, pred, by)
    return rep.groupBy(*by).agg(
        rounded(F.avg("f1"), 4).alias("macro_f1"),
        rounded(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
        rounded(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
    )


def binary_scores(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG18: precision, recall, F1 and accuracy of a boolean prediction, 4 dp."""
    g, p = F.col(gold), F.col(pred)
    c = df.groupBy(*by).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")
    )
    prec, rec = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return c.select(
        *by, rounded(prec, 4).alias("precision"), rounded(rec, 4).alias("recall"), rounded(_f1(prec, rec), 4).alias("f1"), rounded(acc, 4).alias("accuracy")
    )


def false_negative_reasons(df: DataFrame, gold: str, pred: str, reason: str) -> DataFrame:
    """AGG19, FLT12."""
    return df.filter(F.col(gold) & ~F.col(pred)).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def escalation_layers(df: DataFrame, escalate: str = "escalate", reason: str = "escalate_reason") -> DataFrame:
    """AGG20: escalations by layer with percentages; the denominator is at least one."""
    by_rule = F.count_if(F.col(escalate) & F.startswith(F.col(reason), F.lit("rule:")))
    total = F.count_if(escalate)
    base = F.greatest(total, F.lit(1))
    return df.agg(
        total.alias("total_escalations"), by_rule.alias("rule_layer"), (total - by_rule).alias("model_layer"),
        rounded(by_rule / base * 100, 2).alias("rule_pct"), rounded((total - by_rule) / base * 100, 2).alias("model_pct"),
    )


def long_scores(df: DataFrame, ids: Sequence[str], prefix: str, criteria: Sequence[str] = tuple(V.CRITERIA), value: str = "score") -> DataFrame:
    """PRJ32: wide score columns to one row per criterion."""
    renamed = df.select(*ids, *[F.col(f"{prefix}_{c}").alias(c) for c in criteria])
    return renamed.unpivot(list(ids), list(criteria), "criterion", value)


def wide_scores(df: DataFrame, key: str, prefix: str, criteria: Sequence[str] = tuple(V.CRITERIA), score: str = "score", reason: str = "reason") -> DataFrame:
    """PRJ33: one row per criterion to score and reason columns prefixed by the scorer's name.

    Strings are put side by side in sorted order, so rows are placed by key first and sorted once, in parts of bounded size.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PIVOT_ROWS))
    aggs = [F.first(F.when(F.col("criterion") == c, F.col(score)), True).alias(f"{prefix}_{c}") for c in criteria]
    aggs += [F.first(F.when(F.col("criterion") == c, F.col(reason)), True).alias(f"{prefix}_{c}_reason") for c in criteria]
    return df.repartition(parts, key).groupBy(key).agg(*aggs)


def score_stats(long: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """AGG21: mean and sample deviation per criterion, 2 dp."""
    return long.groupBy(*by, "criterion").agg(rounded(F.avg(score), 2).alias("mean"), rounded(F.stddev_samp(score), 2).alias("std"))


def low_score_rate(df: DataFrame, score: str, by: Sequence[str] = (), at_most: int = 2) -> DataFrame:
    """AGG22: rows scored at most 2 and their share."""
    n, k = F.count(F.lit(1)), F.count_if(F.col(score) <= at_most)
    return df.groupBy(*by).agg(k.alias("n_low"), rounded(_ratio(k, n) * 100, 2).alias("low_pct"))


def tier_distribution(df: DataFrame, tier: str = "routing_tier") -> DataFrame:
    """AGG23: every tier with count and percentage, zero where none."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(tier) == t).alias(t) for t in V.TIERS])
    full = one.unpivot(["total"], list(V.TIERS), "tier", "n")
    return full.select("tier", "n", rounded(_ratio(F.col("n"), F.col("total")) * 100, 2).alias("pct"))


def review_precision(df: DataFrame, scores: Sequence[str], tier: str = "routing_tier") -> DataFrame:
    """AGG24, FLT14: share of reviewed rows with any score under 5, and the strict count (any at most 3)."""
    held = F.col(tier) == V.TIER_REVIEW
    cols = [F.col(c) for c in scores]
    total, issue = F.count_if(held), F.count_if(held & low_score(cols, 5))
    return df.agg(
        total.alias("n_review"), issue.alias("n_issue"), F.count_if(held & low_score(cols, 4)).alias("n_strict_issue"),
        rounded(_ratio(issue, total), 4).alias("review_precision"),
    )


def top_confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """AGG29, FLT13: the most frequent wrong pair and its share of all errors."""
    errors = _cells(df.filter(F.col(gold) != F.col(pred)), gold, pred, [])
    total = errors.agg(F.sum("n")).scalar()
    return errors.withColumn("total_errors", total).withColumn("share", rounded(F.col("n") / F.col("total_errors"), 4)).orderBy(
        F.desc("n"), "gold", "pred"
    ).limit(1)


def run_record(runs: DataFrame, facts: dict) -> DataFrame:
    """SNK6: one row that records inputs, thresholds, seed and the run's own row and failure counts."""
    failed = F.count_if(F.startswith("pred_escalate_reason", F.lit("system_error")))
    return runs.agg(
        F.count_distinct("golden_id").alias("total_test_interactions"), F.count(F.lit(1)).alias("n_runs"), failed.alias("failed_examples_count")
    ).select("*", *[F.lit(v).alias(k) for k, v in facts.items()])


def append_record(record: DataFrame, path: str) -> None:
    """SNK6: one more line of JSON behind the records of earlier runs."""
    record.write.mode("append").json(path)


def read_records(spark, path: str) -> DataFrame:
    """Records of all runs."""
    return spark.read.json(path)
