"""Whole-table flows: the message flow, two baselines and the evaluation run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.lexicon import cascade, first_rule, severity
from threadloom.functions.scoring import choose_reply, citations, clamp_score, render_request
from threadloom.functions.text import redact
from threadloom.operators import requests
from threadloom.operators.gate import gate, route, sla_risk
from threadloom.operators.models import TextClassifier, arbitrate
from threadloom.operators.profile import mode
from threadloom.operators.retrieval import ThreadIndex
from threadloom.operators.sampling import random_n
from threadloom.sources.scratch import stage_table


@dataclass
class Lexicons:
    """The word lists and tables a flow works with; keyword cascade, tone words and fixed replies are the brand's own."""

    keywords: Sequence
    default_label: tuple[str, float]
    severe: Sequence[str]
    frustrated: Sequence[str]
    canned: Mapping[str, str]
    rules: Sequence = tuple(V.ESCALATION_RULES)
    urgency: Sequence[str] = tuple(V.URGENCY_WORDS)
    prone: Sequence[str] = tuple(V.PRONE_INTENTS)
    match: str = "word"


def message_flow(
    messages: DataFrame,
    key: str,
    text: str,
    index: ThreadIndex,
    lex: Lexicons,
    classifier: TextClassifier | None = None,
    medians: DataFrame | None = None,
    fallback_minutes: Column | float = V.FALLBACK_MEDIAN_MINUTES,
    drafts: DataFrame | None = None,
    k: int = V.TOP_K,
    min_sim: float = V.MIN_SIMILARITY,
    exclude_self: bool = False,
) -> DataFrame:
    """PIP1: redact, classify, gate, retrieve, route and reply for every message of a table.

    Row-local stages are columns on the message frame; retrieval is the only part that shuffles.  The primary
    label comes from the keyword cascade and, when a trained classifier is given, is arbitrated with it.
    `drafts` may hold externally written replies (key, draft_reply); otherwise the best evidence is the reply.
    """
    df = redact(messages, text)
    label, conf = cascade(F.col("redacted_text"), lex.keywords, lex.default_label, lex.match)
    df = df.withColumn("_label", label).withColumn("_conf", conf)
    if classifier is not None:
        second = classifier.predict(df.select(key, "redacted_text"), key, "redacted_text", "_label2", "_conf2")
        df = arbitrate(df.join(second, key), "_label", "_conf", "_label2", "_conf2").drop("_label2", "_conf2", "was_routed", "disagreed")
    else:
        df = df.withColumn("intent", F.col("_label")).withColumn("confidence", F.col("_conf")).withColumn("classifier_source", F.lit("llm"))
    df = df.drop("_label", "_conf").withColumn("severity", severity(F.col("redacted_text"), lex.severe, lex.frustrated, lex.match))
    df = gate(df, "redacted_text", "intent", "confidence", "severity", lex.rules, lex.prone)
    hits = index.query(df.select(key, "redacted_text"), key, "redacted_text", k, min_sim, exclude_self)
    df = df.join(hits, key)
    ids, replies, best = citations(F.col("hits"))
    df = df.withColumn("retrieved_ids", ids).withColumn("retrieved_replies", replies).withColumn("retrieval_similarity", best).drop("hits")
    df = route(sla_risk(df, "intent", "redacted_text", "severity", medians, fallback_minutes, lex.urgency))
    banner = F.format_string(V.ESCALATED_REPLY, "escalate_reason")
    evidence = F.try_element_at("retrieved_replies", F.lit(1))
    if drafts is not None:
        df = df.join(drafts.select(key, F.col("draft_reply").alias("_draft")), key, "left")
        evidence = F.when(F.size("retrieved_ids") > 0, F.coalesce("_draft", evidence))
    df = df.withColumn("draft_reply", choose_reply(F.col("escalate"), banner, evidence)).withColumn("pii_redacted", F.col("pii_count") > 0)
    return df.drop("_draft")


def canned(df: DataFrame, label: str, replies: Mapping[str, str], handle: str, out: str = "draft_reply") -> DataFrame:
    """PRJ25: the fixed reply of each label, the one for `other` when there is none."""
    table = df.sparkSession.createDataFrame([(k, v.replace("{handle}", handle)) for k, v in replies.items()], f"_l string, {out} string")
    default = replies[V.OTHER_INTENT].replace("{handle}", handle)
    joined = df.join(F.broadcast(table), F.col(label) == F.col("_l"), "left").drop("_l")
    return joined.withColumn(out, F.coalesce(out, F.lit(default)))


def trivial_baseline(messages: DataFrame, labelled: DataFrame, label: str, handle: str, replies: Mapping[str, str]) -> DataFrame:
    """PIP2: the majority label for every message, never escalated, one fixed reply."""
    majority = mode(labelled, label).select("majority_label").scalar()
    df = messages.withColumn("intent", majority).withColumn("confidence", F.lit(1.0))
    df = df.withColumn("escalate", F.lit(False)).withColumn("escalate_reason", F.lit("auto_handle"))
    df = canned(df, "intent", replies, handle)
    none = F.array()
    return df.withColumn("retrieved_ids", none.cast("array<bigint>")).withColumn("retrieved_replies", none.cast("array<string>"))


def simple_baseline(
    messages: DataFrame, key: str, text: str, predictions: DataFrame, index: ThreadIndex,
    rules=tuple(V.ESCALATION_RULES), min_sim: float = V.MIN_SIMILARITY, exclude_self: bool = False,
) -> DataFrame:
    """PIP3: a classifier's label (key, intent, confidence), rules only, the nearest reply word for word (raw text)."""
    df = messages.join(predictions.select(key, "intent", "confidence"), key)
    code, _ = first_rule(F.col(text), rules)
    df = df.withColumn("escalate_reason", F.coalesce(code, F.lit("auto_handle"))).withColumn("escalate", F.col("escalate_reason") != "auto_handle")
    df = df.join(index.query(messages.select(key, text), key, text, 1, min_sim, exclude_self), key)
    ids, replies, best = citations(F.col("hits"))
    df = df.withColumn("retrieved_ids", ids).withColumn("retrieved_replies", replies).withColumn("retrieval_similarity", best).drop("hits")
    banner = F.format_string(V.ESCALATED_BY_RULE_REPLY, "escalate_reason")
    return df.withColumn("draft_reply", choose_reply(F.col("escalate"), banner, F.try_element_at("retrieved_replies", F.lit(1))))


RUN_COLUMNS = [
    "golden_id", "system", "customer_text", "gold_intent", "pred_intent", "confidence", "intent_correct", "gold_escalate", "pred_escalate",
    "escalate_correct", "gold_escalate_reason", "pred_escalate_reason", "routing_tier", "sla_risk_score", "routing_reason",
    "retrieval_similarity", "sample_layer", "draft", "retrieved_ids", "retrieved_replies",
]


def run_frame(system: str, predicted: DataFrame, golden: DataFrame, key: str, text: str, lex: Lexicons, medians: DataFrame | None, fallback: Column | float) -> DataFrame:
    """PIP4: one system's predictions beside the gold columns, in the common run layout.

    A message a system gave no prediction for becomes an escalated default row, so no row is lost.
    A system that does not route itself is routed here, on similarity 0 when it does not retrieve.
    """
    have = set(predicted.columns)
    sim = F.col("retrieval_similarity") if "retrieval_similarity" in have else F.lit(0.0)
    p = predicted.select(
        key, F.col("intent").alias("pred_intent"), "confidence", F.col("escalate").alias("pred_escalate"),
        F.col("escalate_reason").alias("pred_escalate_reason"), sim.alias("retrieval_similarity"), F.col("draft_reply").alias("draft"), "retrieved_ids", "retrieved_replies",
    )
    df = golden.join(p, key, "left")
    failed = F.col("pred_escalate").isNull()
    df = (
        df.withColumn("pred_escalate_reason", F.when(failed, "system_error: no prediction").otherwise(F.col("pred_escalate_reason")))
        .withColumn("pred_intent", F.coalesce("pred_intent", F.lit(V.OTHER_INTENT))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("draft", F.coalesce("draft", F.lit(V.FALLBACK_REPLY))).withColumn("retrieval_similarity", F.coalesce("retrieval_similarity", F.lit(0.0)))
        .withColumn("pred_escalate", F.coalesce("pred_escalate", F.lit(True)))
        .withColumn("retrieved_ids", F.coalesce("retrieved_ids", F.array().cast("array<bigint>")))
        .withColumn("retrieved_replies", F.coalesce("retrieved_replies", F.array().cast("array<string>")))
        .withColumn("severity", severity(F.col(text), lex.severe, lex.frustrated, lex.match))
        .withColumn("escalate", F.col("pred_escalate")).withColumn("escalate_reason", F.col("pred_escalate_reason"))
    )
    df = route(sla_risk(df, "pred_intent", text, "severity", medians, fallback, lex.urgency))
    return df.select(
        F.col(key).alias("golden_id"), F.lit(system).alias("system"), F.col(text).alias("customer_text"), "gold_intent", "pred_intent", "confidence",
        (F.col("pred_intent") == F.col("gold_intent")).alias("intent_correct"), "gold_escalate", "pred_escalate",
        (F.col("pred_escalate") == F.col("gold_escalate")).alias("escalate_correct"), "gold_escalate_reason", "pred_escalate_reason",
        "routing_tier", "sla_risk_score", "routing_reason", "retrieval_similarity", "sample_layer", "draft", "retrieved_ids", "retrieved_replies",
    )


def evaluation_runs(systems: Mapping[str, DataFrame], golden: DataFrame, key: str, text: str, lex: Lexicons, medians: DataFrame | None = None, fallback: Column | float = V.FALLBACK_MEDIAN_MINUTES) -> DataFrame:
    """PIP4, JON16: the union of all systems' run frames; golden has gold_intent, gold_escalate, gold_escalate_reason, sample_layer."""
    out = None
    for name, predicted in systems.items():
        part = run_frame(name, predicted, golden, key, text, lex, medians, fallback)
        out = part if out is None else out.unionByName(part)
    return out


def calibration_set(dev: DataFrame, flow: Callable[[DataFrame], DataFrame], key: str, n: int = 60, seed: int = 42) -> DataFrame:
    """PIP5, PRJ27: n rows of the dev split with the flow's draft and its evidence as JSON text.

    The rows are drawn first, and `flow` runs on them alone.
    """
    size = dev.count()
    if size < n:
        raise ValueError(f"the dev split has fewer rows ({size}) than requested ({n})")
    sample = stage_table(random_n(dev, key, n, seed), "calibration")
    out = sample.join(flow(sample).select(key, "draft_reply", "retrieved_ids", "retrieved_replies"), key)
    return out.select(
        *sample.columns, F.col("draft_reply").alias("agent_draft"), F.to_json("retrieved_replies").alias("retrieved_evidence"), F.to_json("retrieved_ids").alias("retrieved_ids_json")
    )


def judge_requests(runs: DataFrame, instructions: str, model: str, temperature: str = "0.0") -> DataFrame:
    """PIP4: one keyed scoring request per run row: the message, then the reply that is to be judged."""
    evidence = F.array(F.concat(F.lit("Message: "), "customer_text"), F.concat(F.lit("Reply: "), F.coalesce("draft", F.lit(""))))
    prompt = render_request(instructions, evidence, "%d. %s\n", F.lit("Scores:"))
    return requests.keyed(runs.withColumns({"model": F.lit(model), "temperature": F.lit(temperature), "system_prompt": F.lit(""), "prompt": prompt}))


def judge_scores(asked: DataFrame, store: DataFrame, criteria: Sequence[str] = tuple(V.CRITERIA), default: int = 3) -> DataFrame:
    """PIP4, SRC8, PRJ20, PRJ32: scores of every request from stored responses, one row per criterion.

    A response that is missing or cannot be read gives the default score; scores are held inside 1 to 5.
    """
    schema = ", ".join(f"{c} string" for c in criteria)
    read = requests.parsed(requests.lookup(asked, store), schema, list(criteria))
    wide = read.select("golden_id", "system", "parse_ok", *[clamp_score(F.col(f"parsed.{c}"), default).alias(c) for c in criteria])
    return wide.unpivot(["golden_id", "system", "parse_ok"], list(criteria), "criterion", "score")
