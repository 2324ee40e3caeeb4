import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.operators import features
from threadloom.operators import retrieval
from threadloom.operators.retrieval import ThreadIndex, topk_dense, topk_sparse
from threadloom.sources.scratch import shared_folder

SCHEMA = "customer_tweet_id long, customer_text string, brand_tweet_id long, brand_reply_text string, response_time_minutes double"


def thread_rows(n=240, seed=5):
    """A third of the threads are copies of one text, and one word is in most of them."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        t = "hot copy of one text" if i % 3 == 0 else "hot " + " ".join(rnd.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rnd.randint(2, 9)))
        out.append((10_000 + i // 2 * 7, t, 20_000 + i, f"reply {i}", float(i)))
    return out


def tfidf(rows, texts):
    def grams(t):
        k = re.findall(r"\w{2,}", t.lower())
        return k + [f"{a} {b}" for a, b in zip(k, k[1:])]

    docs = [Counter(grams(t)) for t in rows]
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log((1 + len(docs)) / (1 + c)) + 1 for w, c in df.items() if c >= 2}

    def vec(t):
        v = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(grams(t)).items() if w in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()} if n else {}

    return [vec(t) for t in texts]


@pytest.fixture(scope="module")
def index(spark):
    return ThreadIndex.build(spark.createDataFrame(thread_rows(), SCHEMA), stop_words=())


@pytest.mark.parametrize("exclude", [False, True])
def test_query_equals_brute_force_with_hot_copies(spark, index, exclude):
    rows = thread_rows()
    messages = {r[0]: r[1] for r in rows} | {1: "unseen zz yy", 2: "", 3: "w1 w2 hot"}
    docs, queries = tfidf([r[1] for r in rows], [r[1] for r in rows]), dict(zip(messages, tfidf([r[1] for r in rows], messages.values())))
    df = spark.createDataFrame(list(messages.items()), "id long, t string")
    got = {r["id"]: [(h["brand_tweet_id"], h["customer_tweet_id"]) for h in r["hits"]] for r in index.query(df, "id", "t", 3, 0.15, exclude).collect()}
    assert set(got) == set(messages) and got[1] == [] and got[2] == []
    for qid, v in queries.items():
        sims = []
        for r, d in zip(rows, docs):
            s = round(sum(x * d.get(w, 0) for w, x in v.items()), 8)
            if s >= 0.15 and not (exclude and r[0] == qid):
                sims.append((-s, r[2], r[0]))
        assert got[qid] == [(d, o) for _, d, o in sorted(sims)[:3]], qid


def test_small_shards_give_the_same_hits(spark, index):
    q = index.rows.select(F.col("doc_id").alias("query_id"), "term_ids", "weights")
    run = lambda **kw: {r["query_id"]: [tuple(h) for h in r["hits"]] for r in topk_sparse(q, index.rows, 3, 0.15, **kw).collect()}
    assert run() == run(shard_rows=7, query_rows=11)


@pytest.mark.parametrize("cells", [30, 700, 4_000_000])
def test_sparse_scores_are_those_of_all_pairs(monkeypatch, cells):
    """Frequent terms, rare ones, blocks of any size: the pairs and the double-precision sums of a full product."""
    monkeypatch.setattr(retrieval, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(3)
    chance = 0.9 / np.arange(1, 301) ** 0.8

    def rows(n, **more):
        full = np.where(rng.random((n, 300)) < chance, rng.random((n, 300)) + 0.1, 0.0)
        full[np.arange(n), rng.integers(0, 300, n)] += 0.1
        full /= np.sqrt((full**2).sum(1, keepdims=True))
        found = [np.flatnonzero(x) for x in full]
        return full, pd.DataFrame({"term_ids": [f.astype(np.int32) for f in found], "weights": [x[f] for x, f in zip(full, found)], **more})

    d, docs = rows(120, doc_id=np.arange(120), owner_id=np.arange(120) // 2)
    q, queries = rows(40, query_id=np.arange(40) + 1000, floor=np.linspace(0.1, 0.7, 40))
    got = retrieval._sparse_scorer(200, 200)(queries, docs)
    got = {(a, b): s for a, b, s in zip(got["query_id"], got["doc_id"], got["sim"])}
    sims = q @ d.T
    want = {(i + 1000, j): sims[i, j] for i in range(40) for j in range(120) if sims[i, j] >= queries["floor"][i] - retrieval.SLACK}
    assert 100 < len(want) < sims.size / 2 and got.keys() == want.keys()
    assert max(abs(got[p] - want[p]) for p in want) < 1e-14


def test_hits_carry_the_thread(spark, index):
    df = spark.createDataFrame([(1, "hot copy of one text")], "id long, t string")
    hits = index.query(df, "id", "t").first()["hits"]
    assert len(hits) == 3 and hits[0]["similarity"] == 1.0 and hits[0]["brand_reply_text"] == "reply 0" and hits[0]["tweet_id"] == 20_000
    assert index.query(df, "id", "t", k=1).first()["hits"] == hits[:1]


def test_saved_index_answers_alike(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"))
    df = spark.createDataFrame([(1, "hot w1 w3")], "id long, t string")
    again = ThreadIndex.load(spark, str(tmp_path / "ix"))
    assert again.query(df, "id", "t").first() == index.query(df, "id", "t").first()


def staged(spark, name):
    """Tables of that name in the shared folder."""
    from pathlib import Path

    return sum(p.name.startswith(f"{name}-") for p in Path(shared_folder(spark).removeprefix("file:"), "tables").iterdir())


def test_a_stored_index_makes_no_shards_for_queries_and_takes_parts(spark, tmp_path):
    rows = thread_rows()
    path = str(tmp_path / "ix")
    ThreadIndex.build(spark.createDataFrame(rows, SCHEMA), stop_words=()).save(path)
    loaded = ThreadIndex.load(spark, path)
    df = spark.createDataFrame([(1, "hot w1 w3"), (2, "w5 w2 w2")], "id long, t string")
    before = staged(spark, "shards")
    first = loaded.query(df, "id", "t").collect()
    assert loaded.query(df, "id", "t").collect() == first and staged(spark, "shards") == before
    grown = loaded.append(path, spark.createDataFrame([(9_000_000, "w5 w2 w2", 9_000_001, "new reply", 1.0)], SCHEMA))
    assert staged(spark, "shards") == before + 1  # the new part's only
    hits = {r["id"]: r["hits"] for r in grown.query(df, "id", "t").collect()}
    assert "new reply" in [h["brand_reply_text"] for h in hits[2]] and hits[2][0]["similarity"] == 1.0
    assert grown.rows.count() == loaded.rows.count() + 1 and grown.vocab.count() == loaded.vocab.count()
    # More hits than the shards were cut for: exact all the same.
    assert len(grown.query(df, "id", "t", k=retrieval.CITABLE + 5).first()["hits"]) == retrieval.CITABLE + 5


def topics(n, n_topics=40, seed=3):
    """Unit vectors about one topic each: five of its thirty terms, and two of twenty terms that all topics share."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        topic = i * 7919 % n_topics
        weights = {20 + 30 * topic + t: rnd.uniform(0.5, 1.0) for t in rnd.sample(range(30), 5)} | {t: rnd.uniform(0.2, 0.7) for t in rnd.sample(range(20), 2)}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.append((i, i, sorted(weights), [weights[t] / norm for t in sorted(weights)]))
    return out


def test_own_thresholds_leave_most_shards_out(spark):
    docs = spark.createDataFrame(topics(2400), "doc_id long, owner_id long, term_ids array<int>, weights array<double>").repartition(4)
    queries = docs.filter("doc_id % 12 = 0").select(F.col("doc_id").alias("query_id"), "term_ids", "weights")
    shards = retrieval.cut_shards(docs, shard_rows=60)
    n_shards, n_queries = shards.rows.select("shard").distinct().count(), queries.count()
    home = retrieval.home_shards(queries, shards).withColumn("floor", F.lit(0.15))
    score = retrieval._score_shards(home, queries, shards.rows, ["term_ids", "weights"], retrieval._sparse_scorer(3, 3), 5000)
    floors = retrieval._floors(queries, retrieval._ranked(score, 3, 3), 3, 0.15)
    visited = retrieval.routes(queries, floors, shards)
    assert n_shards == 40 and n_queries == 200
    assert visited.count() < n_queries * n_shards / 4
    loose = floors.withColumn("floor", F.lit(0.15))
    assert visited.count() < retrieval.routes(queries, loose, shards).count() / 2, visited.count()
    # And nothing is lost by that.
    want = {r["query_id"]: [tuple(h) for h in r["hits"]] for r in topk_sparse(queries, docs, 3, 0.15, shard_rows=5000).collect()}
    assert {r["query_id"]: [tuple(h) for h in r["hits"]] for r in retrieval.topk_sharded(queries, shards, 3, 0.15).collect()} == want


def test_dense_vectors_of_any_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.8, 0.1, 0.0]), (5, []), (6, None), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [2.0])]
    docs = spark.createDataFrame([(i, i, v) for i, v in rows], "doc_id long, owner_id long, vector array<double>")
    queries = docs.select(F.col("doc_id").alias("query_id"), "vector")
    hits = lambda q, d: {r["query_id"]: [h["doc_id"] for h in r["hits"]] for r in topk_dense(q, d, 3, 0.15, True).collect()}
    assert hits(queries, docs) == {1: [2], 2: [1], 3: [4], 4: [3]}
    assert hits(queries, docs.limit(0)) == {} and hits(queries.limit(0), docs) == {}


def test_dense_cells_are_skipped(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 16)), 40, axis=0) + 0.05 * rng.normal(size=(1200, 16))
    docs = spark.createDataFrame([(i, i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, owner_id long, vector array<double>")
    seen, score = [], retrieval._score_shards

    def counting(where, *rest):
        seen.append(where.count())
        return score(where, *rest)

    monkeypatch.setattr(retrieval, "_score_shards", counting)
    queries = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    topk_dense(queries, docs, 3, 0.15).collect()
    cells = round(1200**0.5)
    assert seen[0] == 120 and sum(seen) < 120 * cells / 2


def test_dense_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    x[::3] = x[0]  # a third are copies
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, owner_id long, vector array<double>")
    queries = docs.select(F.col("doc_id").alias("query_id"), "vector")
    got = {r["query_id"]: [h["doc_id"] for h in r["hits"]] for r in topk_dense(queries, docs, 3, 0.3, True, pivots=6, query_rows=13).collect()}
    for i in range(120):
        s = np.round(unit @ unit[i], 8)
        want = [j for j in sorted(range(120), key=lambda j: (-s[j], j)) if j != i and s[j] >= 0.3][:3]
        assert got.get(i, []) == want


def test_open_vocabulary_gets_dense_ids(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb dd"), (3, "cc aa")], "id int, t string")
    _, vocab = features.fit(df, "id", "t", max_terms=None)
    rows = vocab.collect()
    assert {r["term"] for r in rows} == {"aa", "bb", "cc", "aa bb"} and sorted(r["term_id"] for r in rows) == [0, 1, 2, 3]
    assert {r["term"]: r["df"] for r in rows}["aa"] == 3


def test_vocabulary_limit_falls_anywhere(spark):
    """Limits above, inside and below a group of equal counts; no task sorts all terms."""
    counts = spark.createDataFrame([(i, t, 1 + (t < "d")) for i in range(2) for t in "abcdefghijkl"] + [(9, "zz", 9), (8, "zz", 1)], "id int, term string, tf int")
    totals = sorted(((-4 if t < "d" else -2, t) for t in "abcdefghijkl"), key=lambda x: x) + []
    order = ["zz", *[t for _, t in totals]]
    for limit in (1, 2, 4, 5, 9, 13, 50):
        vocab = features.vocabulary(counts, 2, limit)
        assert sorted(r["term"] for r in vocab.collect()) == sorted(order[:limit]), limit
        assert "TakeOrdered" not in vocab._jdf.queryExecution().executedPlan().toString()
    assert features.vocabulary(counts, 3, 5).count() == 0


def test_weights_have_unit_length(spark):
    df = spark.createDataFrame([(1, "aa bb aa cc"), (2, "aa bb dd"), (3, "zz")], "id int, t string")
    counts, vocab = features.fit(df, "id", "t")
    w = features.weights(counts, vocab, "id", 25000).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r["id"]: round(r["n"], 9) for r in w} == {1: 1.0, 2: 1.0}


def test_an_owner_with_many_different_rows_does_not_hide_the_others(spark):
    own = [(i, 1, [1.0, 0.01 * i]) for i in range(10)]
    docs = spark.createDataFrame([*own, (50, 2, [1.0, 0.6])], "doc_id long, owner_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (7, [1.0, 0.0])], "query_id long, vector array<double>")
    got = {r["query_id"]: [h["doc_id"] for h in r["hits"]] for r in topk_dense(queries, docs, 3, 0.15, True, pivots=3).collect()}
    assert got == {1: [50], 7: [0, 1, 2]}
    unit = lambda v: [x / math.hypot(*v) for x in v]
    sparse = docs.select("doc_id", "owner_id", F.array(F.lit(0), F.lit(1)).alias("term_ids"), F.transform("vector", lambda x: x / F.sqrt(F.get("vector", 0) ** 2 + F.get("vector", 1) ** 2)).alias("weights"))
    asked = spark.createDataFrame([(1, [0, 1], unit([1.0, 0.001])), (7, [0, 1], unit([1.0, 0.001]))], "query_id long, term_ids array<int>, weights array<double>")
    got = {r["query_id"]: [h["doc_id"] for h in r["hits"]] for r in topk_sparse(asked, sparse, 3, 0.15, True, shard_rows=4).collect()}
    assert got == {1: [50], 7: [0, 1, 2]}


def test_sweep_query_keeps_the_cheapest_of_several_starts(spark, monkeypatch):
    from threadloom.operators import models
    from threadloom.plans import retrieval as plans

    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(200)], "vec_id long, embedding array<double>")
    sweep, seen = models.kmeans_sweep, []

    def short(rows, ks=(4,), **options):
        out = sweep(rows, ks=ks, **options)
        seen.extend(r["costs"] for r in out[0].collect())
        return out

    monkeypatch.setattr(models, "kmeans_sweep", short)
    monkeypatch.setattr(plans, "embedding_rows", lambda spark, d: models.dense_features(rows, "vec_id", "embedding"))
    got = plans.clu_kmeans_sweep(spark, "").collect()
    assert [len(c) for c in seen] == [3] and [(r["k"], r["n"], r["in_range"], r["misplaced"]) for r in got] == [(4, 200, True, 0)]


def test_terms_are_counted_in_their_row(spark):
    """No hash table of (key, term) pairs, texts of one key and of no key still count together, and both ways weigh alike."""
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "The aa bb"), (2, "aa cc"), (3, "zz"), (4, None), (None, "bb aa"), (None, "aa"), (5, "aa bb aa, cc aa")], "id int, t string")
    unique = df.filter("id in (1, 3, 4, 5)")
    plan = features.packed_counts(unique, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortAggregate" not in plan
    got = {(r["id"], r["term"]): r["tf"] for r in features.term_counts(df, "id", "t", ["the"]).collect()}
    want = {}
    for i, t in ((1, "aa bb aa"), (2, "aa bb"), (2, "aa cc"), (3, "zz"), (None, "bb aa"), (None, "aa"), (5, "aa bb aa cc aa")):
        words = t.split()
        for term in [*words, *map(" ".join, zip(words, words[1:]))]:
            want[i, term] = want.get((i, term), 0) + 1
    assert got == want
    counts, vocab = features.fit(df, "id", "t", ["the"])
    near = lambda w: sorted((str(r["id"]), r["term"], round(r["weight"], 9)) for r in w.collect())
    by_rows = features.weights(features.counts_of(counts, "id"), vocab, "id", 25000)
    assert near(features.weights(counts, vocab, "id", 25000)) == near(by_rows) and by_rows.count() > 10
    whole = lambda v: sorted((str(r["id"]), r["term_ids"], [round(x, 9) for x in r["weights"]]) for r in v.collect())
    assert whole(features.vectors(counts, vocab, "id", 25000)) == whole(features.vectors(counts, vocab, "id"))


def test_dense_queries_are_copied_once_per_group_of_cells(spark, monkeypatch):
    """Rows without clusters lead to all cells; a query goes to few groups of them and finds what brute force finds."""
    import numpy as np

    from threadloom.operators import retrieval

    x = np.random.default_rng(5).normal(size=(120, 6))
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "doc_id long, owner_id long, vector array<double>")
    queries = rows.select(F.col("doc_id").alias("query_id"), "vector")
    asked, score = [], retrieval._score_shards
    monkeypatch.setattr(retrieval, "_score_shards", lambda routes, *rest: asked.append(routes.count()) or score(routes, *rest))
    got = {r["query_id"]: [h["doc_id"] for h in r["hits"]] for r in topk_dense(queries, rows, 3, 0.15, True, pivots=30, query_rows=40, group_rows=60).collect()}
    assert asked[0] == 120 and asked[1] <= 3 * 120
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    for i in range(120):
        want = [j for j in sorted(range(120), key=lambda j: (-round(sims[i, j], 8), j)) if j != i and round(sims[i, j], 8) >= 0.15][:3]
        assert got.get(i, []) == want
