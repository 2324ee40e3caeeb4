import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.operators import gate, models
from threadloom.operators.ranks import order_hash
from threadloom.operators.retrieval import ThreadIndex
from threadloom.plans import flows
from threadloom.sources import readers
from threadloom.sources.schemas import TWEETS, require_columns

MESSAGES = [
    (1, "my battery drains since the update"), (2, "I will call my lawyer"), (3, "wifi drops, please write to a@b.co"), (4, "qqq zzz"), (5, "charged twice, refund please"),
]

LEX = flows.Lexicons(
    keywords=[("battery_drain_power", 0.95, ["battery"]), ("connectivity_network", 0.94, ["wifi"]), ("billing_app_store", 0.95, ["charged", "refund"])],
    default_label=("other", 0.72), severe=["furious"], frustrated=["annoying"], canned={"battery_drain_power": "Hello from @{handle}", "other": "Hi"},
)


@pytest.fixture(scope="module")
def index(spark):
    rows = [(100 + i, f"my battery drains {w} since the update", 200 + i, f"battery reply {i}", 5.0) for i, w in enumerate(["fast", "daily", "so fast"])]
    rows += [(110 + i, f"wifi drops {w}", 210 + i, f"wifi reply {i}", 6.0) for i, w in enumerate(["often", "again", "daily"])]
    return ThreadIndex.build(spark.createDataFrame(rows, "customer_tweet_id long, customer_text string, brand_tweet_id long, brand_reply_text string, response_time_minutes double"))


def messages(spark):
    return spark.createDataFrame(MESSAGES, "id long, text string")


def test_message_flow(spark, index):
    got = {r["id"]: r for r in flows.message_flow(messages(spark), "id", "text", index, LEX).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["intent"] == "battery_drain_power" and got[1]["draft_reply"].startswith("battery reply") and got[1]["routing_tier"] in V.TIERS
    assert got[2]["escalate_reason"] == "rule:legal_threat" and "rule:legal_threat" in got[2]["draft_reply"] and got[2]["routing_tier"] == "ESCALATE"
    assert got[3]["pii_redacted"] and got[3]["redacted_text"].endswith("[EMAIL_REDACTED]") and got[3]["retrieved_ids"]
    assert got[4]["draft_reply"] == V.FALLBACK_REPLY and got[4]["retrieved_ids"] == [] and got[4]["retrieval_similarity"] == 0.0
    assert got[5]["escalate_reason"] == "model:escalation_prone_intent(intent=billing_app_store)"


def test_baselines_and_evaluation(spark, index):
    labelled = spark.createDataFrame([("other",), ("battery_drain_power",), ("battery_drain_power",)], "intent string")
    trivial = flows.trivial_baseline(messages(spark), labelled, "intent", "Shop", LEX.canned)
    assert {r["intent"] for r in trivial.collect()} == {"battery_drain_power"} and not any(r["escalate"] for r in trivial.collect())
    preds = messages(spark).select("id", F.lit("billing_app_store").alias("intent"), F.lit(0.3).alias("confidence"))
    simple = {r["id"]: r for r in flows.simple_baseline(messages(spark), "id", "text", preds, index).collect()}
    assert simple[2]["escalate"] and not simple[5]["escalate"] and simple[4]["draft_reply"] == V.FALLBACK_REPLY
    golden = messages(spark).select("id", "text", F.lit("other").alias("gold_intent"), (F.col("id") == 2).alias("gold_escalate"), F.lit("r").alias("gold_escalate_reason"), F.lit("base").alias("sample_layer"))
    runs = flows.evaluation_runs({"T": trivial, "half": trivial.filter("id < 3")}, golden, "id", "text", LEX)
    out = {(r["system"], r["golden_id"]): r for r in runs.collect()}
    assert len(out) == 10 and runs.columns == flows.RUN_COLUMNS
    # A message a system failed on stays in the table as an escalated default row.
    assert out[("half", 4)]["pred_escalate_reason"].startswith("system_error") and out[("half", 4)]["pred_escalate"] and out[("T", 2)]["escalate_correct"] is False


def test_calibration_needs_enough_rows(spark, index):
    flow = lambda sample: flows.message_flow(sample, "id", "text", index, LEX)
    assert flows.calibration_set(messages(spark), flow, "id", 3).count() == 3
    with pytest.raises(ValueError):
        flows.calibration_set(messages(spark), flow, "id", 6)


def test_classifier_learns_and_cross_validates(spark):
    rows = [(i, f"battery drains quick {i % 5}" if i % 2 else f"wifi signal drops {i % 7}", "p" if i % 2 else "n") for i in range(60)] + [(99, "noise", "unknown")]
    df = spark.createDataFrame(rows, "id long, t string, y string")
    m = models.TextClassifier.train(df, "id", "t", "y", ["p", "n"])
    got = {r["id"]: (r["intent"], r["confidence"]) for r in m.predict(spark.createDataFrame([(1, "battery quick"), (2, "the wifi signal"), (3, "")], "id long, t string"), "id", "t").collect()}
    assert got[1][0] == "p" and got[2][0] == "n" and got[1][1] > 0.8 and got[3][1] == pytest.approx(0.5, abs=0.05)
    cv = models.cross_validated(df.filter("id < 60"), "id", "t", "y", folds=3).collect()
    assert len(cv) == 60 and all(r["predicted"] == r["gold"] for r in cv)


def test_every_labelled_row_is_learnt_from(spark):
    n = 200_003
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "wifi drops").otherwise("battery drains").alias("t"))
    last = [r["id"] for r in df.orderBy(order_hash(42, F.col("id")).desc()).limit(3).collect()]  # 200,000 of lowest hash were kept
    rare = F.col("id").isin(last)
    df = df.select("id", F.when(rare, "parcel lost").otherwise(F.col("t")).alias("t"), F.when(rare, "r").when(F.col("id") % 2 == 0, "n").otherwise("p").alias("y"))
    m = models.TextClassifier.train(df, "id", "t", "y")
    assert m.labels == ["n", "p", "r"] and m.fitted.count() == n
    got = m.predict(spark.createDataFrame([(1, "the parcel lost"), (2, "wifi drops")], "id long, t string"), "id", "t").collect()
    assert {r["id"]: r["intent"] for r in got} == {1: "r", 2: "n"}


@pytest.mark.parametrize("name", ["cls_pseudo_label", "pip_simple_trained"])
def test_plans_learn_without_a_sample(spark, monkeypatch, tmp_path, name):
    from threadloom.plans.catalog import QUERIES

    said = ["le chat et les chiens mangent", "die katze und der hund schlafen", "los perros de la casa", "the dog sleeps all day"]
    talks = [(i, turn, role, f"{said[i % 4]} {role} {i % 3} " + "word " * 40) for i in range(24) for turn, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = [(i, said[i % 4], "abcd"[i % 4]) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def drawn(*args, **kwargs):
        raise AssertionError("a sample is drawn")

    monkeypatch.setattr(models, "random_n", drawn, raising=False)
    got = {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    each = ["a", "b", "c", "d"] if name == "cls_pseudo_label" else ["de", "en", "es", "fr"]
    n = 3 if name == "cls_pseudo_label" else 6
    assert got == {(k, n, n, n) for k in each}


def test_folds_learn_from_all_other_rows(spark, monkeypatch):
    rows = [(i, f"battery drains quick {i % 5}" if i % 2 else f"wifi signal drops {i % 7}", "p" if i % 2 else "n") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string, y string")
    fits, train = [], models.TextClassifier.train

    def noted(*args, **kwargs):
        fits.append(train(*args, **kwargs))
        return fits[-1]

    def drawn(*args, **kwargs):
        raise AssertionError("a sample is drawn")

    monkeypatch.setattr(models, "random_n", drawn, raising=False)
    monkeypatch.setattr(models.TextClassifier, "train", noted)
    monkeypatch.setattr(models, "FIT_CELLS", 0, raising=False)  # one at a time
    out = models.cross_validated(df, "id", "t", "y", folds=2).collect()
    assert len(out) == 30 and sorted(m.fitted.count() for m in fits) == [14, 16]


def test_fit_is_judged_by_its_gradient(spark):
    rows = [(i, f"battery drains {i % 5}" if i % 3 else f"wifi drops battery {i % 4}", "p" if i % 3 else "n") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, t string, y string")
    m = models.TextClassifier.train(df, "id", "t", "y")
    facts = {r["label"]: r for r in m.optimality().collect()}
    x, y, w, p = [], [], [], []
    for r in m.model.transform(m.fitted).collect():
        x.append(r["features"].toArray()), y.append(int(r["_label"])), w.append(r["_balance"]), p.append(r["probability"].toArray())
    x, p, w, one = np.array(x), np.array(p), np.array(w)[:, None], np.eye(2)[y]
    by_term = ((p - one) * w).T @ x / 50 + m.penalty * m.model.coefficientMatrix.toArray()
    by_label = ((p - one) * w).sum(axis=0) / 50
    for i, label in enumerate(m.labels):
        assert facts[label]["largest"] == pytest.approx(max(abs(by_term[i]).max(), abs(by_label[i])), abs=1e-12) and facts[label]["largest"] < 1e-5
        assert facts[label]["mass"] == pytest.approx(0.5, abs=1e-5)
        assert facts[label]["term_mass"] == pytest.approx((one * w)[:, i] @ x.sum(axis=1) / 50, abs=1e-4)
    early = models.TextClassifier.train(df, "id", "t", "y", max_iter=1).optimality().collect()
    assert max(r["largest"] for r in early) > 1e-3


def test_kmeans_sweep_and_nearest(spark):
    df = spark.range(60).select("id", F.array((F.col("id") % 3 * 10).cast("double"), (F.col("id") / 600)).alias("v"))
    rows = models.dense_features(df, "id", "v")
    sweep, fitted = models.kmeans_sweep(rows, ks=[2, 3])
    assert {r["k"]: sum(r["sizes"]) for r in sweep.collect()} == {2: 60, 3: 60}
    near = models.nearest_members(rows, fitted[3], "id", 4).collect()
    assert len(near) == 12 and {r["rank"] for r in near} == {1, 2, 3, 4}


def test_files_round_trip(spark, tmp_path):
    rows = [(1, "c", True, "d", 'line "one"\nline, two', "5,7", None), (2, "b", False, "d", "x", None, "1")]
    df = spark.createDataFrame(rows, TWEETS)
    readers.write_csv(df, str(tmp_path / "csv"))
    readers.write_parquet(readers.read_tweets_csv(spark, str(tmp_path / "csv")), str(tmp_path / "pq"))
    assert sorted(readers.read_parquet(spark, str(tmp_path / "pq")).collect()) == sorted(df.collect())
    with pytest.raises(FileNotFoundError):
        readers.read_threads(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_split_choice(spark):
    g = spark.createDataFrame([(i, "t", "a", "no", "r") for i in range(6)], ", ".join(f"{c} {'int' if c == 'golden_id' else 'string'}" for c in V.REQUIRED_EVALUATION_COLUMNS))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "golden_id int")
    assert readers.load_split(g, "golden_set.csv", ids(1, 2), ids(3)).count() == 2
    assert readers.load_split(g, "golden_set.csv", None, ids(3)).count() == 1
    assert readers.load_split(g, "golden_test.csv", ids(1)).count() == 6 and readers.load_split(g, "golden_set.csv").count() == 6
    with pytest.raises(ValueError, match="intent"):
        require_columns(g.drop("intent"), V.REQUIRED_EVALUATION_COLUMNS)


def test_streaming_frames_route_like_batch(spark, tmp_path):
    from threadloom.streaming.routing import route_messages

    src = messages(spark).select("id", "text", F.lit("other").alias("intent"), F.lit(0.9).alias("confidence"), F.lit(0.5).alias("retrieval_similarity"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = route_messages(stream, gate.fixed_medians(src), LEX).writeStream.format("memory").queryName("routed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    cols = ["id", "routing_tier", "routing_reason"]
    assert sorted(spark.table("routed").select(cols).collect()) == sorted(route_messages(src, gate.fixed_medians(src), LEX).select(cols).collect())
