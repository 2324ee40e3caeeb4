"""Queries on predictions and scores (P5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.functions import lexicon
from threadloom.functions import values as V
from threadloom.operators import agreement, metrics
from threadloom.plans import vocab as q
from threadloom.plans.registry import query
from threadloom.sources.adapters import SCORES_SQL, line_scores, table
from threadloom.sources.scratch import shared_folder

RUNS_SQL = f"runs AS (SELECT doc_id, lang AS gold, {q.case('text', q.LANG_WORDS, 0, q.LANG_DEFAULT[0])} AS pred, source FROM documents)"


def lang_runs(spark, d):
    """Language as a multi-class gold label, predicted by function words."""
    label, _ = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("gold"), label.alias("pred"), "source")


@query("agg_confusion", f"WITH {RUNS_SQL}, l AS (SELECT unnest(['en', 'fr', 'de', 'es', 'other']) AS x) SELECT a.x AS gold, b.x AS pred, (SELECT count(*) FROM runs WHERE gold = a.x AND pred = b.x) AS n FROM l a, l b")
def agg_confusion(spark, d):
    return metrics.confusion(lang_runs(spark, d), "gold", "pred", [*q.LANGS, "other"])


REPORT_SQL = """rep AS (SELECT l.label, coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(s, 0)::DOUBLE, 0) AS recall, s AS support, tp FROM (
  SELECT label, (SELECT count(*) FROM runs WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM runs WHERE pred = label) AS p, (SELECT count(*) FROM runs WHERE gold = label) AS s
  FROM ({0})) l)"""


@query("agg_class_report", f"WITH {RUNS_SQL}, {REPORT_SQL.format('SELECT unnest([' + chr(39) + (chr(39) + ',' + chr(39)).join([*q.LANGS, 'other']) + chr(39) + ']) AS label')} SELECT label, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, support FROM rep")
def agg_class_report(spark, d):
    rep = metrics.class_report(lang_runs(spark, d), "gold", "pred", labels=[*q.LANGS, "other"])
    return rep.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("agg_macro", f"""WITH {RUNS_SQL}, {REPORT_SQL.format('SELECT gold AS label FROM runs UNION SELECT pred FROM runs')}, f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rep)
SELECT round_even(avg(f1), 4) AS macro_f1, round_even(sum(f1 * support) / sum(support), 4) AS weighted_f1, round_even(sum(tp) / sum(support)::DOUBLE, 4) AS accuracy FROM f""")
def agg_macro(spark, d):
    return metrics.macro_scores(lang_runs(spark, d), "gold", "pred")


@query("agg_top_confusion", f"WITH {RUNS_SQL} SELECT gold, pred, count(*) AS n, (SELECT count(*) FROM runs WHERE gold <> pred) AS total_errors, round_even(count(*) / (SELECT count(*) FROM runs WHERE gold <> pred)::DOUBLE, 4) AS share FROM runs WHERE gold <> pred GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 1")
def agg_top_confusion(spark, d):
    return metrics.top_confusion(lang_runs(spark, d), "gold", "pred")


TOXIC_SQL = f"""runs AS (SELECT doc_id, quality, toxic = 1 AS gold, source, lang, {q.rule_code('text')} AS code, {q.severity('text')} AS sev FROM documents JOIN labels USING (doc_id)),
esc AS (SELECT *, coalesce(code, CASE WHEN lang = 'es' THEN 'model:escalation_prone_intent(intent=es)' WHEN sev = 'severe' THEN 'model:severe_sentiment' ELSE 'auto_handle' END) AS reason FROM runs)"""


def toxic_runs(spark, d):
    """Toxicity as the gold escalation flag, predicted by rules and tone."""
    code, _ = lexicon.first_rule(F.col("text"), q.RULES)
    sev = lexicon.severity(F.col("text"), q.INSULTS, q.GRUMBLES)
    model = F.when(F.col("lang") == "es", "model:escalation_prone_intent(intent=es)").when(sev == "severe", "model:severe_sentiment").otherwise("auto_handle")
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    out = both.select("doc_id", "quality", (F.col("toxic") == 1).alias("gold"), "source", "lang", F.coalesce(code, model).alias("reason"))
    return out.withColumn("pred", F.col("reason") != "auto_handle")


@query("agg_binary_metrics", f"""WITH {TOXIC_SQL}, c AS (SELECT lang, count(*) FILTER (gold AND reason <> 'auto_handle')::DOUBLE AS tp, count(*) FILTER (NOT gold AND reason <> 'auto_handle') AS fp,
count(*) FILTER (gold AND reason = 'auto_handle') AS fn, count(*) AS n, count(*) FILTER (gold = (reason <> 'auto_handle')) AS ok FROM esc GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT lang, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round_even(ok / n::DOUBLE, 4) AS accuracy FROM r""")
def agg_binary_metrics(spark, d):
    return metrics.binary_scores(toxic_runs(spark, d), "gold", "pred", ["lang"])


@query("agg_fn_reasons", f"WITH {TOXIC_SQL} SELECT source, count(*) AS n FROM esc WHERE gold AND reason = 'auto_handle' GROUP BY 1")
def agg_fn_reasons(spark, d):
    return metrics.false_negative_reasons(toxic_runs(spark, d), "gold", "pred", "source")


@query("agg_layers", f"""WITH {TOXIC_SQL}, c AS (SELECT count(*) FILTER (reason <> 'auto_handle') AS n, count(*) FILTER (starts_with(reason, 'rule:')) AS r FROM esc)
SELECT n AS total_escalations, r AS rule_layer, n - r AS model_layer, round_even(r / greatest(n, 1)::DOUBLE * 100, 2) AS rule_pct, round_even((n - r) / greatest(n, 1)::DOUBLE * 100, 2) AS model_pct FROM c""")
def agg_layers(spark, d):
    return metrics.escalation_layers(toxic_runs(spark, d).withColumnRenamed("pred", "escalate"), reason="reason")


RECORD_SQL = "count(DISTINCT doc_id) AS total_test_interactions, count(*) AS n_runs, count(*) FILTER (doc_id % 7 = 0) AS failed_examples_count, {0}::BIGINT AS seed, 0.15::DOUBLE AS retrieval_min_similarity FROM esc"


@query("snk_run_record", f"WITH {TOXIC_SQL} SELECT {RECORD_SQL.format(42)} UNION ALL SELECT {RECORD_SQL.format(43)}")
def snk_run_record(spark, d):
    """SNK6: two runs' records appended to one file and read back; some runs have failed rows."""
    path = f"{shared_folder(spark)}/tables/runs-{uuid.uuid4().hex}"
    reason = F.when(F.col("doc_id") % 7 == 0, "system_error: no prediction").otherwise(F.col("reason"))
    runs = toxic_runs(spark, d).select(F.col("doc_id").alias("golden_id"), reason.alias("pred_escalate_reason"))
    for seed in (42, 43):
        record = metrics.run_record(runs, {"seed": seed, "retrieval_min_similarity": V.MIN_SIMILARITY})
        metrics.append_record(record, path)
    out = metrics.read_records(spark, path)
    return out.withColumn("seed", F.col("seed").cast("bigint"))


# ---- ordinal scores of two scorers --------------------------------------------------------------

S = f"s AS MATERIALIZED ({SCORES_SQL})"
LONG = "long AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT example_id, customer_text, agent_draft, '{c}' AS criterion, human_{c} AS human, judge_v1_{c} AS judge, judge_v2_{c} AS judge2 FROM s" for c in q.CRITERIA
) + ")"


def scores(spark, d):
    return line_scores(table(spark, d, "lineitem"))


@query("prj_unpivot_scores", f"WITH {S}, {LONG} SELECT example_id, criterion, judge::BIGINT AS score FROM long")
def prj_unpivot_scores(spark, d):
    long = metrics.long_scores(scores(spark, d), ["example_id"], "judge_v1")
    return long.withColumn("score", F.col("score").cast("bigint"))


@query("prj_pivot_scores", f"WITH {S} SELECT example_id, " + ", ".join(f"judge_v1_{c} AS judge_v1_{c}, 'reason ' || judge_v1_{c} AS judge_v1_{c}_reason" for c in q.CRITERIA) + " FROM s")
def prj_pivot_scores(spark, d):
    long = metrics.long_scores(scores(spark, d), ["example_id"], "judge_v1").withColumn("reason", F.concat(F.lit("reason "), "score"))
    return metrics.wide_scores(long, "example_id", "judge_v1")


@query("prj_blind_sheet", f"WITH {S} SELECT example_id, customer_text, agent_draft, " + ", ".join(f"NULL::INT AS human_{c}" for c in q.CRITERIA) + ", NULL::VARCHAR AS human_notes FROM s")
def prj_blind_sheet(spark, d):
    return agreement.blind_sheet(scores(spark, d), ["example_id", "customer_text", "agent_draft"])


@query("jon_scores_inner", f"WITH {S} SELECT a.example_id, a.human_correctness, b.judge_v1_correctness FROM s a JOIN s b USING (example_id) WHERE b.judge_v1_tone = 4")
def jon_scores_inner(spark, d):
    s = scores(spark, d)
    return s.select("example_id", "human_correctness").join(s.filter("judge_v1_tone = 4").select("example_id", "judge_v1_correctness"), "example_id")


@query("agg_score_stats", f"WITH {S}, {LONG} SELECT criterion, round_even(avg(judge), 2) AS mean, round_even(stddev_samp(judge), 2) AS std FROM long GROUP BY 1")
def agg_score_stats(spark, d):
    return metrics.score_stats(metrics.long_scores(scores(spark, d), ["example_id"], "judge_v1"))


@query("agg_low_score_rate", f"WITH {S} SELECT agent_draft, count(*) FILTER (judge_v1_groundedness <= 2) AS n_low, round_even(count(*) FILTER (judge_v1_groundedness <= 2) / count(*)::DOUBLE * 100, 2) AS low_pct FROM s GROUP BY 1")
def agg_low_score_rate(spark, d):
    return metrics.low_score_rate(scores(spark, d), "judge_v1_groundedness", ["agent_draft"])


RHO = """{0} AS (SELECT criterion, n, CASE WHEN sxx = 0 OR syy = 0 THEN NULL ELSE sxy / sqrt(sxx * syy) END AS rho FROM (
  SELECT criterion, count(*) AS n, sum((rh - m) * (rj - m)) AS sxy, sum((rh - m) * (rh - m)) AS sxx, sum((rj - m) * (rj - m)) AS syy FROM (
    SELECT criterion, (count(*) OVER (PARTITION BY criterion) + 1) / 2::DOUBLE AS m,
      rank() OVER (PARTITION BY criterion ORDER BY human) + (count(*) OVER (PARTITION BY criterion, human) - 1) / 2::DOUBLE AS rh,
      rank() OVER (PARTITION BY criterion ORDER BY {1}) + (count(*) OVER (PARTITION BY criterion, {1}) - 1) / 2::DOUBLE AS rj FROM long) GROUP BY 1))"""


#: One less twice the density's integral from 0 to t, by Simpson's rule on 4,000 steps.
T_TAIL = """greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * t / 12000 * list_sum(list_transform(range(0, 4001),
lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2))))"""


@query("agg_spearman", f"WITH {S}, {LONG}, {RHO.format('r', 'judge')} SELECT criterion, n, round_even(rho, 6) AS rho, round_even(rho * sqrt((n - 2) / (1 - rho * rho)), 3) AS t_stat, CASE WHEN abs(rho) >= 1 THEN 0 WHEN t IS NOT NULL THEN round_even({T_TAIL}, 6) END AS p_value FROM (SELECT *, n - 2 AS df, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM r)")
def agg_spearman(spark, d):
    pairs = agreement.score_pairs(scores(spark, d), [], "human", "judge_v1")
    out = agreement.spearman(pairs, ["criterion"], "human", "judge")
    return out.select("criterion", "n", F.round("rho", 6).alias("rho"), F.round("t_stat", 3).alias("t_stat"), F.round("p_value", 6).alias("p_value"))


@query("agg_agreement", f"""WITH {S}, {LONG}, {RHO.format('r', 'judge')} SELECT criterion, count(*) AS n, count(*) FILTER (abs(human - judge) >= 2) AS n_large, round_even(count(*) FILTER (abs(human - judge) >= 2) / count(*)::DOUBLE * 100, 2) AS large_pct,
round_even(avg(human), 2) AS mean_human, round_even(avg(judge), 2) AS mean_judge, round_even(avg(abs(human - judge)), 2) AS mean_abs_diff, round_even(any_value(rho), 4) AS rho FROM long JOIN (SELECT criterion, rho FROM r) USING (criterion) GROUP BY 1""")
def agg_agreement(spark, d):
    return agreement.agreement(scores(spark, d), "human", "judge_v1")


@query("agg_round_delta", f"WITH {S}, {LONG}, {RHO.format('a', 'judge')}, {RHO.format('b', 'judge2')} SELECT criterion, round_even(a.rho, 4) AS rho_1, round_even(b.rho, 4) AS rho_2, round_even(round_even(b.rho, 4) - round_even(a.rho, 4), 4) AS delta FROM a FULL JOIN b USING (criterion)")
def agg_round_delta(spark, d):
    s = scores(spark, d)
    return agreement.round_delta(agreement.agreement(s, "human", "judge_v1"), agreement.agreement(s, "human", "judge_v2"))


CAUSE_SQL = """CASE WHEN criterion IN ('correctness', 'completeness') AND judge > human THEN CASE WHEN contains(lower(agent_draft), 'dm') AND length(agent_draft) < 120 THEN 'politeness-over-diagnostic' ELSE 'incomplete-but-plausible' END
WHEN criterion = 'groundedness' AND judge > human THEN 'missed-hallucination' WHEN criterion = 'groundedness' THEN 'overly-strict-groundedness'
WHEN criterion = 'brand_voice' THEN 'brand-voice-judgment' WHEN criterion = 'tone' THEN 'tone-preference' ELSE 'scoring-boundary' END"""


@query("agg_disagreement_causes", f"WITH {S}, {LONG} SELECT {CAUSE_SQL} AS category, count(*) AS n FROM long WHERE abs(human - judge) >= 2 GROUP BY 1")
def agg_disagreement_causes(spark, d):
    return agreement.disagreement_causes(agreement.disagreements(scores(spark, d), "example_id", "customer_text", "agent_draft", "human", "judge_v1"))


@query("agg_disagreements", f"WITH {S}, {LONG} SELECT example_id, criterion, human, judge, abs(human - judge) AS difference, {CAUSE_SQL} AS category FROM long WHERE abs(human - judge) >= 2")
def agg_disagreements(spark, d):
    found = agreement.disagreements(scores(spark, d), "example_id", "customer_text", "agent_draft", "human", "judge_v1")
    return found.select("example_id", "criterion", "human", "judge", "difference", "category").orderBy(F.desc("difference"), "example_id", "criterion")


@query("agg_largest_differences", f"WITH {S}, {LONG} SELECT example_id, criterion, human, judge, abs(human - judge) AS abs_diff FROM long WHERE human <> judge ORDER BY abs_diff DESC, example_id, criterion LIMIT 5")
def agg_largest_differences(spark, d):
    return agreement.largest_differences(scores(spark, d), "example_id", "human", "judge_v1")


@query("agg_score_quality", f"""WITH {S} SELECT 0 AS position, 'row_count' AS "check", CASE WHEN count(*) < 50 OR count(*) > 80 THEN 1 ELSE 0 END::BIGINT AS violations FROM s
UNION ALL SELECT 1, 'duplicate:example_id', count(*) - count(DISTINCT example_id) FROM s """ + " ".join(
    f"UNION ALL SELECT {2 + 2 * i}, 'null:human_{c}', count(*) FILTER (human_{c} IS NULL) FROM s UNION ALL SELECT {3 + 2 * i}, 'range:human_{c}', count(*) FILTER (human_{c} NOT BETWEEN 1 AND 5) FROM s" for i, c in enumerate(q.CRITERIA)
))
def agg_score_quality(spark, d):
    return agreement.score_table_checks(scores(spark, d), "example_id", [f"human_{c}" for c in q.CRITERIA])


@query("agg_first_violation", f"""WITH {S}, c AS (SELECT count(*) AS n, count(DISTINCT example_id) AS k FROM s)
SELECT n BETWEEN 50 AND 80 AND n = k AS valid, CASE WHEN n NOT BETWEEN 50 AND 80 THEN 'row_count' WHEN n > k THEN 'duplicate:example_id' END AS reason FROM c""")
def agg_first_violation(spark, d):
    """AGG31: the verdict over the checks."""
    checks = agreement.score_table_checks(scores(spark, d), "example_id", [f"human_{c}" for c in q.CRITERIA])
    return agreement.first_violation(checks)


ROUTED_SQL = f"""{S}, t AS (SELECT *, CASE WHEN agent_draft LIKE 'dm R%' THEN 'ESCALATE' WHEN human_tone >= 3 THEN 'DRAFT_FOR_REVIEW' ELSE 'AUTO_SEND' END AS tier FROM s)"""


def _tiered(spark, d):
    tier = F.when(F.col("agent_draft").like("dm R%"), V.TIER_ESCALATE).when(F.col("human_tone") >= 3, V.TIER_REVIEW).otherwise(V.TIER_AUTO)
    return scores(spark, d).withColumn("routing_tier", tier)


@query("agg_review_precision", f"""WITH {ROUTED_SQL}, c AS (SELECT count(*) AS n_review, count(*) FILTER (least({', '.join('judge_v1_' + c for c in q.CRITERIA)}) < 5) AS n_issue,
count(*) FILTER (least({', '.join('judge_v1_' + c for c in q.CRITERIA)}) <= 3) AS n_strict_issue FROM t WHERE tier = 'DRAFT_FOR_REVIEW') SELECT *, round_even(n_issue / n_review::DOUBLE, 4) AS review_precision FROM c""")
def agg_review_precision(spark, d):
    return metrics.review_precision(_tiered(spark, d), [f"judge_v1_{c}" for c in q.CRITERIA])
