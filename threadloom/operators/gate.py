"""Escalation gate and three-way routing of every message, as added columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.lexicon import first_rule
from threadloom.functions.scoring import (
    composite_risk,
    invalid_confidence,
    minutes_risk,
    rounded,
    two_places,
    urgency_risk,
    usable_confidence,
)
from threadloom.operators.ranks import grouped_quantiles


def rule_layer(df: DataFrame, text: str, rules=tuple(V.ESCALATION_RULES), code: str = "rule_code", snippet: str = "rule_snippet") -> DataFrame:
    """GAT1, FLT4: code and matched snippet of the first rule that fires."""
    c, s = first_rule(F.col(text), rules)
    return df.withColumn(code, c).withColumn(snippet, F.when(F.col(code).isNotNull(), s))


def model_reason(intent: Column, confidence: Column, severity: Column, prone: Sequence[str] = tuple(V.PRONE_INTENTS), min_confidence: float = V.ESCALATION_CONFIDENCE) -> Column:
    """GAT2, PRJ22: low or invalid confidence, then an escalation-prone label, then severe tone, else auto_handle."""
    conf = usable_confidence(confidence)
    named = F.when(F.coalesce(intent, F.lit("")) == "", F.lit("unknown")).otherwise(intent)
    return (
        F.when(
            invalid_confidence(confidence) | (conf < min_confidence),
            F.format_string("model:low_confidence(intent=%s, conf=%s)", named, two_places(conf)),
        )
        .when(intent.isin(*prone), F.format_string("model:escalation_prone_intent(intent=%s)", intent))
        .when(severity == "severe", F.lit("model:severe_sentiment"))
        .otherwise(F.lit("auto_handle"))
    )


def gate(df: DataFrame, text: str, intent: str, confidence: str, severity: str, rules=tuple(V.ESCALATION_RULES), prone: Sequence[str] = tuple(V.PRONE_INTENTS)) -> DataFrame:
    """GAT3: rules before the model layer; adds escalate and escalate_reason."""
    code, _ = first_rule(F.col(text), rules)
    reason = F.coalesce(code, model_reason(F.col(intent), F.col(confidence), F.col(severity), prone))
    return df.withColumn("escalate_reason", reason).withColumn("escalate", F.col("escalate_reason") != "auto_handle")


def label_medians(labelled: DataFrame, label: str, minutes: str) -> DataFrame:
    """AGG13: median minutes per label, 2 dp; labels that differ in case or outer blanks only are one."""
    named = labelled.select(F.lower(F.trim(label)).alias("intent"), minutes)
    return grouped_quantiles(named, ["intent"], minutes, {"median": 0.5}).select("intent", rounded(F.col("median"), 2).alias("median_minutes"))


def global_median(threads: DataFrame, minutes: str) -> DataFrame:
    """AGG13: median minutes over all threads, 2 dp, one row."""
    return grouped_quantiles(threads, [], minutes, {"median": 0.5}).select(rounded(F.col("median"), 2).alias("median_minutes"))


def fixed_medians(df: DataFrame, medians: Mapping[str, float] = V.INTENT_MEDIAN_MINUTES) -> DataFrame:
    return df.sparkSession.createDataFrame(list(medians.items()), "intent string, median_minutes double")


def sla_risk(
    df: DataFrame, intent: str, text: str, severity: str, medians: DataFrame | None = None,
    fallback: Column | float = V.FALLBACK_MEDIAN_MINUTES, urgency_words: Sequence[str] = tuple(V.URGENCY_WORDS),
) -> DataFrame:
    """PRJ15-PRJ17, JON13: adds intent_risk, sentiment_risk and sla_risk_score.

    The medians have one row per label and are broadcast: by label, few tasks would read all messages.
    """
    m = medians if medians is not None else fixed_medians(df)
    m = m.select(F.col("intent").alias("_label"), F.col("median_minutes").alias("_minutes"))
    key = F.lower(F.trim(F.col(intent)))
    other = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    joined = df.join(F.broadcast(m), key == F.col("_label"), "left")
    return (
        joined.withColumn("_minutes", F.coalesce(F.col("_minutes"), other))
        .withColumn("intent_risk", minutes_risk(F.col("_minutes")))
        .withColumn("sentiment_risk", urgency_risk(F.col(text), F.col(severity), urgency_words))
        .withColumn("sla_risk_score", composite_risk(F.col("intent_risk"), F.col("sentiment_risk")))
        .drop("_label", "_minutes")
    )


def route(df: DataFrame, similarity: str = "retrieval_similarity", min_sim: float = V.AUTO_SEND_SIMILARITY, max_risk: float = V.AUTO_SEND_RISK) -> DataFrame:
    """RTE1, PRJ29: tier and reason from escalate, escalate_reason, similarity and sla_risk_score."""
    sim, risk = F.coalesce(F.col(similarity), F.lit(0.0)), F.col("sla_risk_score")
    auto = (sim >= min_sim) & (risk <= max_risk)
    tier = F.when(F.col("escalate"), V.TIER_ESCALATE).when(auto, V.TIER_AUTO).otherwise(V.TIER_REVIEW)
    low = F.when(sim < min_sim, F.format_string("lower retrieval similarity (%s < %s)", two_places(sim), F.lit(str(min_sim))))
    high = F.when(risk > max_risk, F.format_string("higher SLA risk (%s > %s)", two_places(risk), F.lit(str(max_risk))))
    reason = (
        F.when(F.col("escalate"), F.concat(F.lit("Escalated via gate: "), F.col("escalate_reason")))
        .when(auto, F.format_string(
            "High retrieval confidence (%s >= %s) and low SLA risk (%s <= %s)",
            two_places(sim), F.lit(str(min_sim)), two_places(risk), F.lit(str(max_risk)),
        ))
        .otherwise(F.concat(F.lit("Drafted for review due to "), F.array_join(F.array_compact(F.array(low, high)), " and ")))
    )
    return df.withColumn("routing_tier", tier).withColumn("routing_reason", reason)
