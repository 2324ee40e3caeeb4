"""Failure mining over run frames: one representative row per failure mode.

Each miner is a bounded top-1 over the whole run frame (no id is singled out) and returns the common columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.text import anonymize, redact
from threadloom.operators.metrics import top_confusion

COLUMNS = [
    "failure_mode", "failure_rank", "example_id", "customer_text_anonymized", "gold_label", "predicted_label", "reason",
    "agent_draft", "hypothesis", "proposed_fix", "source_result_file",
]


def _shape(df: DataFrame, rank: int, gold: Column, pred: Column, reason: Column, source: str, notes: tuple[str, str]) -> DataFrame:
    out = anonymize(df, "customer_text", "customer_text_anonymized")
    return out.select(
        F.lit(V.FAILURE_MODES[rank]).alias("failure_mode"), F.lit(rank).alias("failure_rank"), F.col("golden_id").alias("example_id"), "customer_text_anonymized",
        gold.alias("gold_label"), pred.alias("predicted_label"), reason.alias("reason"), F.col("draft").alias("agent_draft"),
        F.lit(notes[0]).alias("hypothesis"), F.lit(notes[1]).alias("proposed_fix"), F.lit(source).alias("source_result_file"),
    )


def intent_confusion(runs: DataFrame, notes: tuple[str, str] = ("", "")) -> DataFrame:
    """FAL1: the top confusion pair and its first row by id."""
    pair = F.broadcast(top_confusion(runs, "gold_intent", "pred_intent").select(F.col("gold").alias("gold_intent"), F.col("pred").alias("pred_intent"), F.col("n").alias("pair_n")))
    row = runs.join(pair, ["gold_intent", "pred_intent"]).orderBy("golden_id").limit(1)
    reason = F.format_string("Confusion count = %d instances across test split", "pair_n")
    return _shape(row, 1, F.col("gold_intent"), F.col("pred_intent"), reason, "all_runs", notes)


def missed_escalation(runs: DataFrame, notes: tuple[str, str] = ("", "")) -> DataFrame:
    """FAL2, FLT12: the first row that should have been escalated and was not."""
    row = runs.filter(F.col("gold_escalate") & ~F.col("pred_escalate")).orderBy("golden_id").limit(1)
    reason = F.concat(F.lit("Gold: "), F.col("gold_escalate_reason"), F.lit(" | Pred: "), F.col("pred_escalate_reason"))
    return _shape(row, 2, F.lit("escalate = True"), F.lit("escalate = False"), reason, "all_runs", notes)


def lowest_groundedness(comparison: DataFrame, sample: DataFrame, notes: tuple[str, str] = ("", "")) -> DataFrame:
    """FAL3, JON17, SRT5: the row with the lowest human groundedness, with both scorers' values."""
    low = comparison.orderBy(F.asc_nulls_last("human_groundedness"), "golden_id").limit(1)
    row = low.select("golden_id", "human_groundedness", "judge_v1_groundedness").join(sample, "golden_id")
    reason = F.format_string("groundedness: human %d, judge %d", "human_groundedness", "judge_v1_groundedness")
    return _shape(row, 3, F.lit("grounded = True"), F.lit("grounded = False"), reason, "comparison", notes)


def weak_evidence(runs: DataFrame, min_sim: float = 0.15, notes: tuple[str, str] = ("", "")) -> DataFrame:
    """FAL4: the answered row whose best evidence cleared the threshold by least."""
    row = runs.filter(F.col("retrieval_similarity") >= min_sim).orderBy("retrieval_similarity", "golden_id").limit(1)
    reason = F.format_string("Best retrieval similarity was %.4f", "retrieval_similarity")
    return _shape(row, 4, F.col("gold_intent"), F.col("pred_intent"), reason, "all_runs", notes)


def leaking_reply(runs: DataFrame, notes: tuple[str, str] = ("", "")) -> DataFrame:
    """FAL5: the first verbatim reply that shows a handle or personal data."""
    seen = redact(runs, "draft", "_redacted", "_pii", "_types")
    row = seen.filter((F.col("_pii") > 0) | F.col("draft").rlike("@[A-Za-z0-9_]+")).orderBy("golden_id").limit(1)
    reason = F.format_string("Verbatim reply exposes personal data or a handle (%d redactable items)", "_pii")
    return _shape(row, 5, F.col("gold_intent"), F.col("pred_intent"), reason, "all_runs", notes)


def failure_table(*parts: DataFrame) -> DataFrame:
    """FAL6."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
