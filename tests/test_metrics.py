import pytest
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.operators import agreement, failures, metrics, models, requests

RUN = "golden_id int, gold_intent string, pred_intent string, gold_escalate boolean, pred_escalate boolean, gold_escalate_reason string, pred_escalate_reason string, customer_text string, draft string, retrieval_similarity double"


def runs(spark):
    rows = [
        (1, "a", "a", True, True, "risk", "rule:abuse", "t1", "d1", 0.9),
        (2, "a", "b", False, False, None, "auto_handle", "mail me a@b.co", "d2", 0.2),
        (3, "a", "b", True, False, "money", "auto_handle", "t3 @joe", "call 415-555-0182", 0.16),
        (4, "c", "c", False, True, None, "model:severe_sentiment", "t4", "hi @joe", 0.05),
    ]
    return spark.createDataFrame(rows, RUN)


def test_class_metrics_match_hand_counts(spark):
    r = {x["label"]: x for x in metrics.class_report(runs(spark), "gold_intent", "pred_intent").collect()}
    assert r["a"]["precision"] == 1.0 and r["a"]["recall"] == pytest.approx(1 / 3) and r["b"]["f1"] == 0.0 and r["c"]["f1"] == 1.0
    m = metrics.macro_scores(runs(spark), "gold_intent", "pred_intent").first()
    assert (m["macro_f1"], m["weighted_f1"], m["accuracy"]) == (0.5, 0.625, 0.5)
    full = metrics.class_report(runs(spark), "gold_intent", "pred_intent", labels=["a", "zz"]).collect()
    assert {x["label"]: x["support"] for x in full} == {"a": 3, "zz": 0}


def test_confusion_is_dense_and_complete(spark):
    cells = metrics.confusion(runs(spark), "gold_intent", "pred_intent", ["a", "b", "c"]).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 4


def test_escalation_metrics(spark):
    b = metrics.binary_scores(runs(spark), "gold_escalate", "pred_escalate").first()
    assert tuple(b) == (0.5, 0.5, 0.5, 0.5)
    assert [tuple(x) for x in metrics.false_negative_reasons(runs(spark), "gold_escalate", "pred_escalate", "gold_escalate_reason").collect()] == [("money", 1)]
    layers = metrics.escalation_layers(runs(spark), "pred_escalate", "pred_escalate_reason").first()
    assert tuple(layers) == (2, 1, 1, 50.0, 50.0)
    none = metrics.escalation_layers(runs(spark).filter("golden_id = 2"), "pred_escalate", "pred_escalate_reason").first()
    assert none["rule_pct"] == 0.0


def test_top_confusion_and_tiers(spark):
    t = metrics.top_confusion(runs(spark), "gold_intent", "pred_intent").first()
    assert (t["gold"], t["pred"], t["n"], t["total_errors"], t["share"]) == ("a", "b", 2, 2, 1.0)
    df = spark.createDataFrame([("AUTO_SEND", 5), ("DRAFT_FOR_REVIEW", 5), ("DRAFT_FOR_REVIEW", 4), ("DRAFT_FOR_REVIEW", 3)], "routing_tier string, s int")
    assert {r["tier"]: (r["n"], r["pct"]) for r in metrics.tier_distribution(df).collect()} == {"AUTO_SEND": (1, 25.0), "DRAFT_FOR_REVIEW": (3, 75.0), "ESCALATE": (0, 0.0)}
    p = metrics.review_precision(df, ["s"]).first()
    assert (p["n_review"], p["n_issue"], p["n_strict_issue"], p["review_precision"]) == (3, 2, 1, 0.6667)


def test_pivot_and_unpivot_are_inverse(spark):
    wide = spark.createDataFrame([(1, 5, 4, 3, 2, 1), (2, 1, 1, 1, 1, 1)], "id int, " + ", ".join(f"j_{c} int" for c in V.CRITERIA))
    long = metrics.long_scores(wide, ["id"], "j").withColumn("reason", F.lit("r"))
    back = metrics.wide_scores(long, "id", "j").select(wide.columns)
    assert sorted(back.collect()) == sorted(wide.collect())


def test_pivot_sorts_once(spark):
    wide = spark.createDataFrame([(i, 5, 4, 3, 2, 1) for i in range(9)], "id int, " + ", ".join(f"j_{c} int" for c in V.CRITERIA))
    long = metrics.long_scores(wide, ["id"], "j").withColumn("reason", F.lit("r"))
    plan = metrics.wide_scores(long, "id", "j")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def comparison(spark):
    rows = [(1, "t", "send a DM", 2, 5, 3, 3), (2, "t", "long answer", 4, 4, 1, 5), (3, "t", "x", 3, 3, 5, 2)]
    return spark.createDataFrame(rows, "example_id int, customer_text string, agent_draft string, human_correctness int, j_correctness int, human_groundedness int, j_groundedness int")


def test_disagreements_and_agreement(spark):
    full = comparison(spark)
    for c in ("completeness", "brand_voice", "tone"):
        full = full.withColumn(f"human_{c}", F.lit(3)).withColumn(f"j_{c}", F.lit(3))
    found = {(r["example_id"], r["criterion"]): (r["difference"], r["category"]) for r in agreement.disagreements(full, "example_id", "customer_text", "agent_draft", "human", "j").collect()}
    assert found == {(1, "correctness"): (3, "politeness-over-diagnostic"), (2, "groundedness"): (4, "missed-hallucination"), (3, "groundedness"): (3, "overly-strict-groundedness")}
    a = {r["criterion"]: r for r in agreement.agreement(full, "human", "j").collect()}
    assert a["tone"]["rho"] is None and a["correctness"]["n_large"] == 1 and a["correctness"]["large_pct"] == 33.33 and a["groundedness"]["rho"] < 0
    delta = {r["criterion"]: r["delta"] for r in agreement.round_delta(agreement.agreement(full, "human", "j"), agreement.agreement(full, "human", "human")).collect()}
    assert delta["tone"] is None and delta["groundedness"] > 0


def score_rows(spark, n, bad=None, dup=False):
    rows = [((0 if dup and i == 1 else i), *( [bad if (bad and i == 3) else "4"] * 2)) for i in range(n)]
    return spark.createDataFrame(rows, "example_id int, h1 string, h2 string")


@pytest.mark.parametrize("kw, reason", [(dict(n=60), None), (dict(n=40), "row_count"), (dict(n=60, dup=True), "duplicate:example_id"), (dict(n=60, bad="7"), "range:h1"), (dict(n=60, bad="2.5"), "range:h1")])
def test_score_table_checks(spark, kw, reason):
    v = agreement.first_violation(agreement.score_table_checks(score_rows(spark, **kw), "example_id", ["h1", "h2"])).first()
    assert (v["valid"], v["reason"]) == (reason is None, reason)


def test_score_table_missing_columns(spark):
    v = agreement.first_violation(agreement.score_table_checks(score_rows(spark, 60), "example_id", ["h1", "h9"])).first()
    assert v["reason"] == "missing:h9"


def test_failure_miners(spark):
    r = runs(spark)
    table = failures.failure_table(failures.intent_confusion(r), failures.missed_escalation(r), failures.weak_evidence(r), failures.leaking_reply(r)).collect()
    assert [x["example_id"] for x in table] == [2, 3, 3, 3] and table[0].asDict().keys() == dict.fromkeys(failures.COLUMNS).keys()
    assert table[0]["customer_text_anonymized"] == "mail me [EMAIL_REDACTED]" and table[1]["reason"] == "Gold: money | Pred: auto_handle"
    low = failures.lowest_groundedness(
        spark.createDataFrame([(1, 3, 5), (2, 1, 5)], "golden_id int, human_groundedness int, judge_v1_groundedness int"),
        spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "golden_id int, customer_text string, draft string"),
    ).first()
    assert low["example_id"] == 2 and low["reason"] == "groundedness: human 1, judge 5"


def test_request_store(spark):
    req = requests.keyed(spark.createDataFrame([("m", 0.0, None, "p1"), ("m", 0.0, None, "p2"), ("m", 0.0, None, "p2")], "model string, temperature double, system_prompt string, prompt string"))
    key = req.filter("prompt = 'p1'").first()["key"]
    store = spark.createDataFrame([(key, '```json\n{"score": 4}\n```')], "key string, response string")
    assert requests.misses(req, store).count() == 1
    answers = requests.parsed(requests.lookup(req, store), "score int", ["score"])
    assert tuple(requests.audit(answers).first()) == (1, 2, 0)


def test_arbitration(spark):
    rows = [("a", 0.9, "b", 0.95), ("a", 0.4, "b", 0.6), ("a", 0.4, "b", 0.3), ("a", 0.4, "a", 0.9)]
    out = models.arbitrate(spark.createDataFrame(rows, "p string, pc double, s string, sc double"), "p", "pc", "s", "sc")
    assert [(r["intent"], r["confidence"], r["classifier_source"]) for r in out.collect()] == [("a", 0.9, "llm"), ("b", 0.6, "tfidf_routed"), ("a", 0.4, "llm"), ("a", 0.4, "llm")]
    assert tuple(models.arbitration_stats(out).first()) == (1, 3, 2)
