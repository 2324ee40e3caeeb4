import math

import pytest
from pyspark.sql import functions as F

from threadloom.functions import lexicon
from threadloom.functions import values as V
from threadloom.operators import gate

CASES = {
    "rule:legal_threat": "My attorney will file a legal complaint",
    "rule:safety": "the back panel is swelling and hot",
    "rule:security": "help, my account has been hacked",
    "rule:media": "I'm a journalist and need a comment",
    "rule:abuse": "go to hell",
    "rule:pii_needed": "they want my social security number",
}


def gated(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, intent string, confidence double")
    df = df.withColumn("severity", lexicon.severity(F.col("text"), ["catastrophic"], ["annoying"]))
    out = gate.gate(df, "text", "intent", "confidence", "severity").orderBy("i").collect()
    return [(r["escalate"], r["escalate_reason"]) for r in out]


def test_each_rule_code(spark):
    got = gated(spark, [(t, "other", 0.92) for t in CASES.values()])
    assert got == [(True, c) for c in CASES]


def test_model_layer_order(spark):
    got = gated(spark, [
        ("hello there", "other", 0.25), ("hello there", "billing_app_store", 0.9), ("hello", "account_icloud_login", 0.9),
        ("this is catastrophic", "other", 0.8), ("my screen has an issue", "other", 0.9), ("see my attorney", "other", 0.10), ("", "other", 0.9),
        ("x", "other", None), ("x", "other", math.nan), ("x", None, -0.5), ("x", "other", 1.5),
    ])
    assert got == [
        (True, "model:low_confidence(intent=other, conf=0.25)"), (True, "model:escalation_prone_intent(intent=billing_app_store)"),
        (True, "model:escalation_prone_intent(intent=account_icloud_login)"), (True, "model:severe_sentiment"), (False, "auto_handle"),
        (True, "rule:legal_threat"), (False, "auto_handle"), (True, "model:low_confidence(intent=other, conf=0.00)"),
        (True, "model:low_confidence(intent=other, conf=0.00)"), (True, "model:low_confidence(intent=unknown, conf=0.00)"),
        (True, "model:low_confidence(intent=other, conf=0.00)"),
    ]


def test_snippet_is_the_first_match(spark):
    df = spark.createDataFrame([("We may SUE, says my lawyer",), ("fine",)], "t string")
    assert [tuple(r) for r in gate.rule_layer(df, "t").select("rule_code", "rule_snippet").collect()] == [("rule:legal_threat", "SUE"), (None, None)]


def test_risk_is_monotone_and_falls_back(spark):
    medians = spark.createDataFrame([("a", 20.0), ("b", 50.0), ("c", 80.0), ("d", 200.0)], "intent string, median_minutes double")
    rows = ["a", "b", " C ", "d", None, "", "zz"]
    df = spark.createDataFrame([(i, x, "hi", "routine") for i, x in enumerate(rows)], "i int, intent string, t string, s string")
    got = [r["intent_risk"] for r in gate.sla_risk(df, "intent", "t", "s", medians).orderBy("i").collect()]
    assert got[:4] == sorted(got[:4]) and got[0] == 0.0 and got[3] == 1.0
    assert got[4] == got[5] == got[6] == round((72.98 - 35) / 70, 4)


def test_urgency(spark):
    rows = [("", "severe"), ("hi", "routine"), ("now ASAP", "routine"), ("x", "severe"), ("urgent", "severe"), ("x", "odd"), (None, "severe")]
    df = spark.createDataFrame([(i, "other", *r) for i, r in enumerate(rows)], "i int, intent string, t string, s string")
    got = [r["sentiment_risk"] for r in gate.sla_risk(df, "intent", "t", "s").orderBy("i").collect()]
    assert got == [0.10, 0.10, 0.25, 1.0, 1.0, 0.30, 0.10]


@pytest.mark.parametrize("escalate, sim, risk, tier, words", [
    (True, 0.9, 0.1, "ESCALATE", "Escalated via gate: rule:x"), (False, 0.85, 0.2, "AUTO_SEND", "High retrieval confidence (0.85 >= 0.4)"),
    (False, 0.25, 0.2, "DRAFT_FOR_REVIEW", "lower retrieval similarity (0.25 < 0.4)"), (False, 0.75, 0.9, "DRAFT_FOR_REVIEW", "higher SLA risk (0.90 > 0.45)"),
    (False, None, 0.9, "DRAFT_FOR_REVIEW", "(0.00 < 0.4) and higher"),
])
def test_tiers(spark, escalate, sim, risk, tier, words):
    df = spark.createDataFrame([(escalate, "rule:x", sim, risk)], "escalate boolean, escalate_reason string, retrieval_similarity double, sla_risk_score double")
    r = gate.route(df).first()
    assert r["routing_tier"] == tier and words in r["routing_reason"]


def test_label_medians(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 4.0), ("a", 10.005), ("b", 7.0), ("b", None)], "l string, m double")
    assert {r[0]: r[1] for r in gate.label_medians(df, "l", "m").collect()} == {"a": 3.5, "b": 7.0}
    assert gate.global_median(df, "m").first()[0] == 4.0


def test_messages_are_not_dealt_out_by_label(spark):
    """A handful of labels would be a handful of tasks, each with the texts of its label."""
    df = spark.createDataFrame([(i, "text", "Billing " if i % 2 else None, "severe") for i in range(6)], "id int, t string, l string, s string")
    out = gate.sla_risk(df, "l", "t", "s", gate.fixed_medians(df, {"billing": 100.0}))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["intent_risk"] for r in out.collect()}[1] != {r["id"]: r["intent_risk"] for r in out.collect()}[0] and out.count() == 6
