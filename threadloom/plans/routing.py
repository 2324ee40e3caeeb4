"""Queries on the gate, routing, whole-message flows, evaluation runs and failure mining (P4, P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import lexicon
from threadloom.functions import values as V
from threadloom.operators import failures, gate, metrics
from threadloom.plans import flows
from threadloom.plans import vocab as q
from threadloom.plans.registry import query
from threadloom.plans.retrieval import GOLD_WORDS, LABELLED, RANKED, labelled_messages, message_table, prediction_facts, thread_index, trained
from threadloom.plans.scores import S, TOXIC_SQL, scores, toxic_runs
from threadloom.plans.texts import ALL, _redacted
from threadloom.sources.adapters import table
from threadloom.sources.scratch import stage_table

PRONE = ["de"]


def reason_sql(code: str, intent: str, conf: str, sev: str) -> str:
    return f"""coalesce({code}, CASE WHEN {conf} IS NULL OR isnan({conf}) OR {conf} < 0 OR {conf} > 1 OR {conf} < 0.4::DOUBLE THEN printf('model:low_confidence(intent=%s, conf=%.2f)', {intent}, CASE WHEN {conf} IS NULL OR isnan({conf}) OR {conf} < 0 OR {conf} > 1 THEN 0 ELSE {conf} END)
WHEN {intent} IN ('de') THEN printf('model:escalation_prone_intent(intent=%s)', {intent}) WHEN {sev} = 'severe' THEN 'model:severe_sentiment' ELSE 'auto_handle' END)"""


def risk_sql(source: str, intent: str, sev: str, text: str, urgent) -> str:
    """CTE body adding the three risks to `source`."""
    med = "CASE " + " ".join(f"WHEN {intent} = '{k}' THEN {v}" for k, v in q.LANG_MEDIANS.items()) + " ELSE 72.98 END::DOUBLE"
    base = f"CASE {sev} WHEN 'routine' THEN 0.1 WHEN 'frustrated' THEN 0.6 WHEN 'severe' THEN 1.0 ELSE 0.3 END::DOUBLE"
    return f"""SELECT *, printf('%.4f', greatest(0, least(1, 0.5::DOUBLE * intent_risk + 0.5::DOUBLE * sentiment_risk)))::DOUBLE AS sla_risk_score FROM (
SELECT *, printf('%.4f', greatest(0, least(1, ({med} - 35) / 70)))::DOUBLE AS intent_risk, printf('%.4f', CASE WHEN {text} = '' THEN 0.1::DOUBLE WHEN {q.has(text, urgent)} THEN least(1::DOUBLE, {base} + 0.15::DOUBLE) ELSE {base} END)::DOUBLE AS sentiment_risk FROM {source})"""


TIER_SQL = "CASE WHEN escalate THEN 'ESCALATE' WHEN sim >= 0.4::DOUBLE AND sla_risk_score <= 0.45::DOUBLE THEN 'AUTO_SEND' ELSE 'DRAFT_FOR_REVIEW' END"
WHY_SQL = """CASE WHEN escalate THEN 'Escalated via gate: ' || reason WHEN sim >= 0.4::DOUBLE AND sla_risk_score <= 0.45::DOUBLE THEN printf('High retrieval confidence (%.2f >= 0.4) and low SLA risk (%.2f <= 0.45)', sim, sla_risk_score)
ELSE 'Drafted for review due to ' || concat_ws(' and ', CASE WHEN sim < 0.4::DOUBLE THEN printf('lower retrieval similarity (%.2f < 0.4)', sim) END, CASE WHEN sla_risk_score > 0.45::DOUBLE THEN printf('higher SLA risk (%.2f > 0.45)', sla_risk_score) END) END"""

# Documents as messages; every 0 < confidence issue occurs: NULL for src1, NaN for src2, negative for src4.
DOC_CONF = f"CASE source WHEN 'src1' THEN NULL WHEN 'src2' THEN 'nan'::DOUBLE WHEN 'src4' THEN -0.5::DOUBLE ELSE {q.case('text', q.LANG_WORDS, 1, q.LANG_DEFAULT[1])} END"
DOCS_SQL = f"m AS MATERIALIZED (SELECT doc_id, text, {q.case('text', q.LANG_WORDS, 0, q.LANG_DEFAULT[0])} AS intent, {DOC_CONF} AS conf, {q.severity('text')} AS sev, {q.rule_code('text')} AS code, round_even(least(1, n_chars / 5000::DOUBLE), 4) AS sim FROM documents)"
GATED_SQL = f"{DOCS_SQL}, g AS (SELECT *, {reason_sql('code', 'intent', 'conf', 'sev')} AS reason FROM m)"


def doc_messages(spark, d):
    label, conf = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    src = F.col("source")
    conf = F.when(src == "src1", None).when(src == "src2", float("nan")).when(src == "src4", -0.5).otherwise(conf)
    return table(spark, d, "documents").select(
        "doc_id", "text", label.alias("intent"), conf.alias("confidence"), lexicon.severity(F.col("text"), q.INSULTS, q.GRUMBLES).alias("severity"),
        F.round(F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)), 4).alias("retrieval_similarity"),
    )


def routed_docs(spark, d):
    df = gate.gate(doc_messages(spark, d), "text", "intent", "confidence", "severity", q.RULES, PRONE)
    return gate.route(gate.sla_risk(df, "intent", "text", "severity", gate.fixed_medians(df, q.LANG_MEDIANS), urgency_words=q.URGENT))


@query("gat_gate", f"WITH {GATED_SQL} SELECT doc_id, reason <> 'auto_handle' AS escalate, reason AS escalate_reason FROM g")
def gat_gate(spark, d):
    out = gate.gate(doc_messages(spark, d), "text", "intent", "confidence", "severity", q.RULES, PRONE)
    return out.select("doc_id", "escalate", "escalate_reason")


@query("gat_sla_risk", f"WITH {DOCS_SQL}, k AS ({risk_sql('m', 'intent', 'sev', 'text', q.URGENT)}) SELECT doc_id, intent_risk, sentiment_risk, sla_risk_score FROM k")
def gat_sla_risk(spark, d):
    df = doc_messages(spark, d)
    out = gate.sla_risk(df, "intent", "text", "severity", gate.fixed_medians(df, q.LANG_MEDIANS), urgency_words=q.URGENT)
    return out.select("doc_id", "intent_risk", "sentiment_risk", "sla_risk_score")


ROUTED_SQL = f"{GATED_SQL}, g2 AS (SELECT *, reason <> 'auto_handle' AS escalate FROM g), k AS MATERIALIZED ({risk_sql('g2', 'intent', 'sev', 'text', q.URGENT)})"


@query("rte_route", f"WITH {ROUTED_SQL} SELECT doc_id, {TIER_SQL} AS routing_tier, {WHY_SQL} AS routing_reason, sla_risk_score FROM k")
def rte_route(spark, d):
    return routed_docs(spark, d).select("doc_id", "routing_tier", "routing_reason", "sla_risk_score")


@query("agg_route_distribution", f"WITH {ROUTED_SQL}, t AS (SELECT {TIER_SQL} AS tier FROM k) SELECT x AS tier, (SELECT count(*) FROM t WHERE tier = x) AS n, round_even((SELECT count(*) FROM t WHERE tier = x) / (SELECT count(*) FROM t)::DOUBLE * 100, 2) AS pct FROM (SELECT unnest(['AUTO_SEND', 'DRAFT_FOR_REVIEW', 'ESCALATE']) AS x)")
def agg_route_distribution(spark, d):
    return metrics.tier_distribution(routed_docs(spark, d))


# ---- flows over the customer messages of the conversations ----------------------------------------

LEX = flows.Lexicons(
    rules=[("rule:legal_threat", [r"\b(?:heat|rest)\b", r"\b(?:thing)\b"]), ("rule:safety", [r"\b(?:los|sich)\b", r"\b(?:pour)\b"])],
    keywords=q.LANG_WORDS, default_label=q.LANG_DEFAULT, severe=["inst", "mit", "par"], frustrated=["that", "des", "was"], urgency=["this", "und"], prone=PRONE,
    canned={"en": "Thanks, @{handle} is here.", "fr": "Merci, @{handle}.", "other": "Hello from @{handle}."},
)
MSG_RULES = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{c}'" for c, ps in LEX.rules for p in ps) + " END"
MSG_SEV = f"CASE WHEN {q.has('text', LEX.severe)} THEN 'severe' WHEN {q.has('text', LEX.frustrated)} THEN 'frustrated' ELSE 'routine' END"
FLOW = f"""{RANKED},
top AS (SELECT qid, max(CASE WHEN rank = 1 THEN similarity END) AS sim, string_agg(d::VARCHAR, ',' ORDER BY rank) AS ids, max(CASE WHEN rank = 1 THEN brand_reply_text END) AS best
  FROM hits JOIN docs USING (d, o) GROUP BY qid),
m AS MATERIALIZED (SELECT qid, text, {q.case('text', q.LANG_WORDS, 0, q.LANG_DEFAULT[0])} AS intent, {q.case('text', q.LANG_WORDS, 1, q.LANG_DEFAULT[1])} AS conf, {MSG_SEV} AS sev, {MSG_RULES} AS code,
  coalesce(sim, 0) AS sim, coalesce(ids, '') AS ids, best FROM msgs LEFT JOIN top USING (qid)),
g AS (SELECT *, {reason_sql('code', 'intent', 'conf', 'sev')} AS reason FROM m), g2 AS (SELECT *, reason <> 'auto_handle' AS escalate FROM g),
k AS MATERIALIZED ({risk_sql('g2', 'intent', 'sev', 'text', LEX.urgency)})"""
BANNER = V.ESCALATED_REPLY.replace("%s", "' || reason || '")
DRAFT_SQL = f"CASE WHEN escalate THEN '{BANNER}' ELSE coalesce(best, '{V.FALLBACK_REPLY}') END"


def message_flow(spark, d, msgs=None):
    msgs = message_table(spark, d) if msgs is None else msgs
    return flows.message_flow(msgs, "tweet_id", "text", thread_index(spark, d), LEX, medians=gate.fixed_medians(msgs, q.LANG_MEDIANS), exclude_self=True)


@query("pip_message_flow", f"WITH {FLOW} SELECT qid AS tweet_id, intent, conf AS confidence, escalate, reason AS escalate_reason, sim AS retrieval_similarity, ids AS retrieved_ids, sla_risk_score, {TIER_SQL} AS routing_tier, {WHY_SQL} AS routing_reason, {DRAFT_SQL} AS draft_reply, false AS pii_redacted FROM k")
def pip_message_flow(spark, d):
    return message_flow(spark, d).select(
        "tweet_id", "intent", "confidence", "escalate", "escalate_reason", "retrieval_similarity", F.array_join("retrieved_ids", ",").alias("retrieved_ids"),
        "sla_risk_score", "routing_tier", "routing_reason", "draft_reply", "pii_redacted",
    )


def gold_messages(spark, d):
    """Customer messages with gold columns: label by other function words, escalation by length."""
    label, _ = lexicon.cascade(F.col("text"), GOLD_WORDS, ("en", 0.5))
    return message_table(spark, d).select(
        "tweet_id", "text", label.alias("gold_intent"), (F.char_length("text") > 700).alias("gold_escalate"), F.lit("long text").alias("gold_escalate_reason"), F.lit("base").alias("sample_layer")
    )


GOLD_SQL = f"gold AS MATERIALIZED (SELECT qid, {q.case('text', GOLD_WORDS, 0, 'en')} AS gold_intent, length(text) > 700 AS gold_escalate FROM msgs)"
MODE_SQL = "(SELECT gold_intent FROM gold GROUP BY 1 ORDER BY count(*) DESC, gold_intent LIMIT 1)"
CANNED_SQL = "CASE m WHEN 'en' THEN 'Thanks, @Brand is here.' WHEN 'fr' THEN 'Merci, @Brand.' ELSE 'Hello from @Brand.' END"


def trivial(spark, d):
    gold = gold_messages(spark, d)
    return flows.trivial_baseline(message_table(spark, d), gold, "gold_intent", "Brand", LEX.canned)


def cascade_predictions(spark, d):
    label, conf = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    return message_table(spark, d).select("tweet_id", label.alias("intent"), conf.alias("confidence"))


def simple(spark, d, index=None):
    return flows.simple_baseline(
        message_table(spark, d), "tweet_id", "text", cascade_predictions(spark, d), index or thread_index(spark, d), LEX.rules, exclude_self=True
    )


@query("pip_trivial", f"WITH {q.T}, msgs AS (SELECT tweet_id AS qid, text FROM tweets WHERE inbound), {GOLD_SQL}, m AS (SELECT {MODE_SQL} AS m) SELECT qid AS tweet_id, m AS intent, 1::DOUBLE AS confidence, false AS escalate, 'auto_handle' AS escalate_reason, {CANNED_SQL} AS draft_reply FROM msgs, m")
def pip_trivial(spark, d):
    return trivial(spark, d).select("tweet_id", "intent", "confidence", "escalate", "escalate_reason", "draft_reply")


RULE_BANNER = V.ESCALATED_BY_RULE_REPLY.replace("%s", "' || code || '")


@query("pip_simple", f"WITH {FLOW} SELECT qid AS tweet_id, intent, conf AS confidence, code IS NOT NULL AS escalate, coalesce(code, 'auto_handle') AS escalate_reason, sim AS retrieval_similarity, CASE WHEN code IS NOT NULL THEN '{RULE_BANNER}' ELSE coalesce(best, '{V.FALLBACK_REPLY}') END AS draft_reply FROM k")
def pip_simple(spark, d):
    return simple(spark, d).select("tweet_id", "intent", "confidence", "escalate", "escalate_reason", "retrieval_similarity", "draft_reply")


@query("pip_simple_trained", f"WITH {LABELLED} SELECT label, count(*) AS n, count(*) AS n_valid, count(*) AS n_keys FROM labelled GROUP BY 1")
def pip_simple_trained(spark, d):
    """PIP3 with CLS1: the classifier learns from the labelled messages; every message comes out once."""
    predictions = trained(spark, d).predict(message_table(spark, d), "tweet_id", "text")
    out = flows.simple_baseline(message_table(spark, d), "tweet_id", "text", predictions, thread_index(spark, d), LEX.rules, exclude_self=True)
    return prediction_facts(out.select("tweet_id", "intent", "confidence").join(labelled_messages(spark, d).select("tweet_id", "label"), "tweet_id"), "intent", "confidence", "label")


def evaluation(spark, d):
    index = thread_index(spark, d)
    msgs = message_table(spark, d)
    full = flows.message_flow(msgs, "tweet_id", "text", index, LEX, medians=gate.fixed_medians(msgs, q.LANG_MEDIANS), exclude_self=True)
    systems = {"TrivialBaseline": trivial(spark, d), "SimpleBaseline": simple(spark, d, index), "FullAgent": full}
    runs = flows.evaluation_runs(systems, gold_messages(spark, d), "tweet_id", "text", LEX, gate.fixed_medians(msgs, q.LANG_MEDIANS))
    return stage_table(runs, "all_runs")


RUNS3 = f"""{FLOW}, {GOLD_SQL},
r0 AS (SELECT qid, text, sev, 'TrivialBaseline' AS system, {MODE_SQL} AS intent, 1::DOUBLE AS conf, false AS escalate, 'auto_handle' AS reason, 0::DOUBLE AS sim FROM m
  UNION ALL SELECT qid, text, sev, 'SimpleBaseline', intent, conf, code IS NOT NULL, coalesce(code, 'auto_handle'), sim FROM m
  UNION ALL SELECT qid, text, sev, 'FullAgent', intent, conf, escalate, reason, sim FROM g2),
r AS MATERIALIZED (SELECT * FROM ({risk_sql('r0', 'intent', 'sev', 'text', LEX.urgency)}) JOIN gold USING (qid))"""


@query("pip_evaluation", f"WITH {RUNS3} SELECT qid AS golden_id, system, gold_intent, intent AS pred_intent, intent = gold_intent AS intent_correct, escalate AS pred_escalate, escalate = gold_escalate AS escalate_correct, reason AS pred_escalate_reason, {TIER_SQL} AS routing_tier, sla_risk_score, sim AS retrieval_similarity FROM r")
def pip_evaluation(spark, d):
    return evaluation(spark, d).select(
        "golden_id", "system", "gold_intent", "pred_intent", "intent_correct", "pred_escalate", "escalate_correct", "pred_escalate_reason", "routing_tier", "sla_risk_score", "retrieval_similarity"
    )


@query("pip_evaluation_scores", f"""WITH {RUNS3}, l AS (SELECT DISTINCT system, x FROM (SELECT system, gold_intent AS x FROM r UNION SELECT system, intent FROM r)),
c AS (SELECT system, x, (SELECT count(*) FROM r WHERE r.system = l.system AND gold_intent = x AND intent = x) AS tp, (SELECT count(*) FROM r WHERE r.system = l.system AND intent = x) AS p, (SELECT count(*) FROM r WHERE r.system = l.system AND gold_intent = x) AS s FROM l),
f AS (SELECT *, coalesce(2 * tp / nullif(p + s, 0)::DOUBLE, 0) AS f1 FROM c)
SELECT system, round_even(avg(f1), 4) AS macro_f1, round_even(sum(f1 * s) / sum(s), 4) AS weighted_f1, round_even(sum(tp) / sum(s)::DOUBLE, 4) AS accuracy FROM f GROUP BY 1""")
def pip_evaluation_scores(spark, d):
    return metrics.macro_scores(evaluation(spark, d), "gold_intent", "pred_intent", ["system"])


@query("pip_calibration", f"""WITH {FLOW} SELECT qid AS tweet_id, {DRAFT_SQL} AS agent_draft, '[' || ids || ']' AS retrieved_ids_json FROM k ORDER BY md5('42:' || qid), qid LIMIT 20""")
def pip_calibration(spark, d):
    out = flows.calibration_set(message_table(spark, d), lambda sample: message_flow(spark, d, sample), "tweet_id", 20)
    return out.select("tweet_id", "agent_draft", "retrieved_ids_json")


JUDGED = f"""WITH {q.T}, msgs AS (SELECT tweet_id AS qid, text FROM tweets WHERE inbound), r AS (SELECT s AS system, qid, text, length(text) < 500 AS parse_ok FROM msgs, (SELECT unnest(['TrivialBaseline', 'Silent']) AS s)),
j AS (SELECT system, unnest({q.CRITERIA}) AS criterion, unnest([{', '.join(f"CASE WHEN parse_ok THEN least(5, 1 + (length(text) + {i}) % 6) ELSE 3 END" for i in range(len(q.CRITERIA)))}]) AS score, parse_ok FROM r)
SELECT system, criterion, round_even(avg(score), 2) AS mean, round_even(stddev_samp(score), 2) AS std, count(*) FILTER (score <= 2) AS n_low, round_even(count(*) FILTER (score <= 2) / count(*)::DOUBLE * 100, 2) AS low_pct, count(*) FILTER (parse_ok) AS n_ok FROM j GROUP BY 1, 2"""


@query("pip_judge_scores", JUDGED)
def pip_judge_scores(spark, d):
    """PIP4, AGG21, AGG22: stored scores of two systems' replies, per system; long texts have no stored response."""
    msgs = message_table(spark, d)
    systems = {"TrivialBaseline": trivial(spark, d), "Silent": trivial(spark, d).withColumn("draft_reply", F.lit(None).cast("string"))}
    runs = flows.evaluation_runs(systems, gold_messages(spark, d), "tweet_id", "text", LEX, gate.fixed_medians(msgs, q.LANG_MEDIANS))
    asked = stage_table(flows.judge_requests(runs, "Score the reply from 1 to 5.\n", "judge-a"), "requests")
    fields = [F.format_string(f'"{c}": "%d"', 1 + (F.char_length("customer_text") + i) % 6) for i, c in enumerate(q.CRITERIA)]
    answered = asked.filter(F.char_length("customer_text") < 500).select("key", F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("response"))
    long = stage_table(flows.judge_scores(asked, answered.dropDuplicates(["key"]), q.CRITERIA), "judge-scores")
    low = metrics.low_score_rate(long, "score", ["system", "criterion"])
    ok = long.groupBy("system", "criterion").agg(F.count_if("parse_ok").alias("n_ok"))
    return metrics.score_stats(long, ["system"]).join(low, ["system", "criterion"]).join(ok, ["system", "criterion"])


# ---- failure mining -------------------------------------------------------------------------------


def mined_runs(spark, d):
    """Documents with labels as runs; the verbatim draft is the text itself."""
    label, _ = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("customer_text"), label.alias("pred_intent"), F.round(F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)), 4).alias("retrieval_similarity"))
    return toxic_runs(spark, d).join(docs, "doc_id").select(
        F.col("doc_id").alias("golden_id"), "customer_text", F.col("lang").alias("gold_intent"), "pred_intent", F.col("gold").alias("gold_escalate"), F.col("pred").alias("pred_escalate"),
        F.col("source").alias("gold_escalate_reason"), F.col("reason").alias("pred_escalate_reason"), "retrieval_similarity", F.col("customer_text").alias("draft"),
    )


MINED = f"""{TOXIC_SQL}, runs3 AS MATERIALIZED (SELECT doc_id AS golden_id, d.text AS customer_text, e.lang AS gold_intent, {q.case('d.text', q.LANG_WORDS, 0, q.LANG_DEFAULT[0])} AS pred_intent, gold AS gold_escalate, reason <> 'auto_handle' AS pred_escalate,
e.source AS gold_escalate_reason, reason AS pred_escalate_reason, round_even(least(1, n_chars / 5000::DOUBLE), 4) AS retrieval_similarity FROM esc e JOIN documents d USING (doc_id))"""


def mined_sql(ctes: str, pick: str, mode: str, rank: int, gold: str, pred: str, reason: str, source: str) -> str:
    chain = _redacted("SELECT *, customer_text AS t FROM pick", ALL).removeprefix("WITH ")
    anon = "regexp_replace(regexp_replace(regexp_replace(t, '@[A-Za-z0-9_]+', '@[USER]', 'g'), 'https?://[^\\s\\p{Z}]+', '[URL]', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
    return f"""WITH {ctes}, pick AS MATERIALIZED ({pick}), {chain}
SELECT '{mode}' AS failure_mode, {rank} AS failure_rank, golden_id AS example_id, {anon} AS customer_text_anonymized, {gold} AS gold_label, {pred} AS predicted_label, {reason} AS reason, draft AS agent_draft, '' AS hypothesis, '' AS proposed_fix, '{source}' AS source_result_file FROM s4"""


FAL1 = mined_sql(
    MINED + ", pair AS (SELECT gold_intent, pred_intent, count(*) AS pair_n FROM runs3 WHERE gold_intent <> pred_intent GROUP BY 1, 2 ORDER BY pair_n DESC, gold_intent, pred_intent LIMIT 1)",
    "SELECT *, customer_text AS draft FROM runs3 JOIN pair USING (gold_intent, pred_intent) ORDER BY golden_id LIMIT 1", "Biggest Intent Confusion Pair", 1, "gold_intent", "pred_intent", "printf('Confusion count = %d instances across test split', pair_n)", "all_runs",
)
FAL2 = mined_sql(
    MINED, "SELECT *, customer_text AS draft FROM runs3 WHERE gold_escalate AND NOT pred_escalate ORDER BY golden_id LIMIT 1", "Escalation False Negative (Missed Escalation)", 2, "'escalate = True'", "'escalate = False'",
    "'Gold: ' || gold_escalate_reason || ' | Pred: ' || pred_escalate_reason", "all_runs",
)
FAL4 = mined_sql(
    MINED, "SELECT *, customer_text AS draft FROM runs3 WHERE retrieval_similarity >= 0.15::DOUBLE ORDER BY retrieval_similarity, golden_id LIMIT 1", "Retrieval Found Irrelevant Context & LLM Improvised", 4, "gold_intent", "pred_intent",
    "printf('Best retrieval similarity was %.4f', retrieval_similarity)", "all_runs",
)
_HITS = _redacted("SELECT *, customer_text AS t FROM runs3", ALL, "z").removeprefix("WITH ").rstrip()
FAL5 = mined_sql(
    MINED + ", " + _HITS, "SELECT * EXCLUDE (t, n_email, n_phone, n_digits, n_device), n_email + n_phone + n_digits + n_device AS pii, customer_text AS draft FROM z4 WHERE n_email + n_phone + n_digits + n_device > 0 OR regexp_matches(customer_text, '@[A-Za-z0-9_]+') ORDER BY golden_id LIMIT 1",
    "Naive Verbatim Nearest-Neighbor Retrieval Failure (Baseline Risk)", 5, "gold_intent", "pred_intent", "printf('Verbatim reply exposes personal data or a handle (%d redactable items)', pii)", "all_runs",
)
FAL3 = mined_sql(
    S, "SELECT example_id AS golden_id, customer_text, agent_draft AS draft, human_groundedness AS h, judge_v1_groundedness AS j FROM s ORDER BY human_groundedness, example_id LIMIT 1",
    "Lowest Reply Quality / Groundedness & Hallucination Failure", 3, "'grounded = True'", "'grounded = False'", "printf('groundedness: human %d, judge %d', h, j)", "comparison",
)


@query("fal_intent_confusion", FAL1)
def fal_intent_confusion(spark, d):
    return failures.intent_confusion(mined_runs(spark, d))


@query("fal_missed_escalation", FAL2)
def fal_missed_escalation(spark, d):
    return failures.missed_escalation(mined_runs(spark, d))


@query("fal_lowest_groundedness", FAL3)
def fal_lowest_groundedness(spark, d):
    s = scores(spark, d).withColumnRenamed("example_id", "golden_id")
    return failures.lowest_groundedness(s, s.select("golden_id", "customer_text", F.col("agent_draft").alias("draft")))


@query("fal_weak_evidence", FAL4)
def fal_weak_evidence(spark, d):
    return failures.weak_evidence(mined_runs(spark, d))


@query("fal_leaking_reply", FAL5)
def fal_leaking_reply(spark, d):
    return failures.leaking_reply(mined_runs(spark, d))


@query("fal_table", " UNION ALL ".join(f"SELECT * REPLACE (example_id::VARCHAR AS example_id) FROM ({x})" for x in (FAL1, FAL2, FAL3, FAL4, FAL5)))
def fal_table(spark, d):
    runs = stage_table(mined_runs(spark, d), "all_runs")  # mining reads the stored runs several times
    example = lambda df: df.withColumn("example_id", F.col("example_id").cast("string"))  # scored rows have ids of letters
    mined = [failures.intent_confusion(runs), failures.missed_escalation(runs), fal_lowest_groundedness(spark, d), failures.weak_evidence(runs), failures.leaking_reply(runs)]
    return failures.failure_table(*map(example, mined))
