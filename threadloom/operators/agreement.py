"""Agreement between two ordinal scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.scoring import rounded, student_t_two_sided
from threadloom.operators.ranks import average_ranks, value_positions
from threadloom.sources.scratch import cut_lineage


def score_pairs(df: DataFrame, keep: Sequence[str], left: str, right: str, criteria: Sequence[str] = tuple(V.CRITERIA)) -> DataFrame:
    """PRJ32 on both scorers at once: (keep..., criterion, human, judge)."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("criterion"), F.col(f"{left}_{c}").alias("human"), F.col(f"{right}_{c}").alias("judge")) for c in criteria
    ])).alias("x")
    return df.select(*keep, rows).select(*keep, "x.*")


def spearman(pairs: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """AGG25, WIN9: rank correlation with average ranks, n, the t statistic and the two-sided p-value; NULL when a
    side is constant.  A correlation of one or minus one has no t and the p-value 0; under three rows have no p-value.

    Rows are first counted per (group, x, y); ranks are those of the value counts, so no row-level sort or
    window happens.  Centred sums keep the arithmetic small.
    """
    cells = cut_lineage(pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("w")))
    rank = lambda c: average_ranks(value_positions(cells, by, c, weight="w")).select(*by, c, F.col("rank").alias(f"r_{c}"), F.col("total").alias(f"t_{c}"))
    both = cells.join(rank(x), [*by, x]).join(rank(y), [*by, y])
    mid = (F.col(f"t_{x}") + 1) / F.lit(2.0)
    dx, dy = F.col(f"r_{x}") - mid, F.col(f"r_{y}") - mid
    s = both.groupBy(*by).agg(
        F.sum("w").alias("n"), F.sum(dx * dy * F.col("w")).alias("sxy"), F.sum(dx * dx * F.col("w")).alias("sxx"), F.sum(dy * dy * F.col("w")).alias("syy")
    )
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    t = rho * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - rho * rho))
    out = s.select(*by, "n", rho.alias("rho"), t.alias("t_stat"))
    exact = F.when((F.col("n") > 2) & (F.abs("rho") >= 1), 0.0)
    return out.withColumn("p_value", F.coalesce(exact, student_t_two_sided(F.col("t_stat"), F.col("n") - 2)))


def agreement(df: DataFrame, left: str, right: str, criteria: Sequence[str] = tuple(V.CRITERIA)) -> DataFrame:
    """AGG26: per criterion rho, differences of two points or more, means of both sides and of the difference."""
    pairs = score_pairs(df, [], left, right, criteria)
    gap = F.abs(F.col("human") - F.col("judge"))
    n, big = F.count(F.lit(1)), F.count_if(gap >= 2)
    stats = pairs.groupBy("criterion").agg(
        n.alias("n"), big.alias("n_large"), rounded(big / n * 100, 2).alias("large_pct"), rounded(F.avg("human"), 2).alias("mean_human"),
        rounded(F.avg("judge"), 2).alias("mean_judge"), rounded(F.avg(gap), 2).alias("mean_abs_diff"),
    )
    rho = spearman(pairs, ["criterion"], "human", "judge").select("criterion", rounded(F.col("rho"), 4).alias("rho"))
    return stats.join(rho, "criterion", "left")


def disagreements(df: DataFrame, key: str, text: str, draft: str, left: str, right: str, reason_suffix: str | None = None) -> DataFrame:
    """AGG27, SRT3: rows two or more points apart with the cause the scores point to."""
    pairs = score_pairs(df, [key, text, draft], left, right)
    h, j, c = F.col("human"), F.col("judge"), F.col("criterion")
    polite = F.contains(F.lower(draft), F.lit("dm")) & (F.char_length(draft) < 120)
    cause = (
        F.when(c.isin("correctness", "completeness") & (j > h), F.when(polite, V.CAUSE_POLITE).otherwise(V.CAUSE_INCOMPLETE))
        .when((c == "groundedness") & (j > h), V.CAUSE_HALLUCINATION)
        .when((c == "groundedness") & (h > j), V.CAUSE_STRICT)
        .when(c == "brand_voice", V.CAUSE_BRAND)
        .when(c == "tone", V.CAUSE_TONE)
        .otherwise(V.CAUSE_BOUNDARY)
    )
    return pairs.withColumn("difference", F.abs(h - j)).filter("difference >= 2").withColumn("category", cause)


def disagreement_causes(found: DataFrame) -> DataFrame:
    """AGG27: rows per cause."""
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def largest_differences(df: DataFrame, key: str, left: str, right: str, n: int = 5) -> DataFrame:
    """AGG34: the n largest differences, ties by id and criterion."""
    pairs = score_pairs(df, [key], left, right).withColumn("abs_diff", F.abs(F.col("human") - F.col("judge")))
    return pairs.filter("abs_diff > 0").orderBy(F.desc("abs_diff"), key, "criterion").limit(n)


def round_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """AGG28: change of rho between two rounds, NULL when either is undefined."""
    a = first.select("criterion", F.col("rho").alias("rho_1"))
    b = second.select("criterion", F.col("rho").alias("rho_2"))
    return a.join(b, "criterion", "full").withColumn("delta", rounded(F.col("rho_2") - F.col("rho_1"), 4))


def score_table_checks(df: DataFrame, key: str, score_columns: Sequence[str], min_rows: int = 50, max_rows: int = 80) -> DataFrame:
    """AGG31: one row per check with its number of violations, in the order the checks apply.

    A missing column is one violation and ends the list, as the later checks cannot be read then.
    """
    missing = [c for c in [key, *score_columns] if c not in df.columns]
    n = F.count(F.lit(1))
    checks = [("row_count", F.when((n < min_rows) | (n > max_rows), 1).otherwise(0))]
    if key in missing:
        checks.append((f"missing:{key}", F.lit(1)))
    else:
        checks.append((f"duplicate:{key}", n - F.count_distinct(key)))
        for c in score_columns:
            if c in missing:
                checks.append((f"missing:{c}", F.lit(1)))
                break
            value = F.col(c).try_cast("double")
            checks.append((f"null:{c}", F.count_if(F.col(c).isNull())))
            checks.append((f"range:{c}", F.count_if(F.col(c).isNotNull() & ~F.coalesce(value.isin(1.0, 2.0, 3.0, 4.0, 5.0), F.lit(False)))))
    one = df.agg(*[e.cast("bigint").alias(f"c{i}") for i, (_, e) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("check"), F.col(f"c{i}").alias("violations")) for i, (name, _) in enumerate(checks)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def first_violation(checks: DataFrame) -> DataFrame:
    """AGG31: the verdict: valid, or the first failing check."""
    bad = F.min_by("check", F.when(F.col("violations") > 0, F.col("position")))
    first = F.min(F.when(F.col("violations") > 0, F.col("position")))
    return checks.agg(first.isNull().alias("valid"), F.when(first.isNotNull(), bad).alias("reason"))


def blind_sheet(df: DataFrame, keep: Sequence[str], criteria: Sequence[str] = tuple(V.CRITERIA)) -> DataFrame:
    """PRJ31: texts and evidence with empty score columns; no score of any model remains."""
    return df.select(*keep, *[F.lit(None).cast("int").alias(f"human_{c}") for c in criteria], F.lit(None).cast("string").alias("human_notes"))
