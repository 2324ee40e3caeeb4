import random
import statistics

import pytest
from pyspark.sql import functions as F

from threadloom.operators import agreement, profile, ranks, sampling


def values(n=4000, seed=3):
    rnd = random.Random(seed)
    # One value holds a third of the rows of the hot group.
    return [("hot" if i % 3 else "cold", 5.0 if i % 3 == 1 else round(rnd.gauss(0, 50), 3)) for i in range(n)]


@pytest.mark.parametrize("buckets", [None, 1, 64])
@pytest.mark.parametrize("by", [["g"], []])
def test_positions_and_quantiles_are_exact_for_any_bucket_count(spark, buckets, by):
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double")
    got = {tuple(r[b] for b in by): r for r in ranks.grouped_quantiles(df, by, "v", {"p25": 0.25, "median": 0.5}, buckets).collect()}
    for key in ({("hot",), ("cold",)} if by else {()}):
        mine = sorted(v for g, v in rows if not by or g == key[0])
        assert got[key]["total"] == len(mine)
        assert got[key]["median"] == pytest.approx(statistics.median(mine))
        assert got[key]["p25"] == pytest.approx(statistics.quantiles(mine, n=4, method="inclusive")[0])


def test_bucketed_ranks_equal_brute_force(spark):
    rows = values(900)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["v"]): r["rank"] for r in ranks.average_ranks(ranks.value_positions(df, ["g"], "v", buckets=16)).collect()}
    for g in ("hot", "cold"):
        mine = sorted(v for x, v in rows if x == g)
        for v in set(mine):
            places = [i + 1 for i, x in enumerate(mine) if x == v]
            assert got[(g, v)] == sum(places) / len(places)


def test_position_by_hash_numbers_every_row(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g")).withColumn("h", ranks.order_hash(1, F.col("id")))
    got = ranks.position_by_hash(df, ["g"], "h", "id").collect()
    for g in "ab":
        mine = sorted([r for r in got if r["g"] == g], key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["h"] for r in mine] == sorted(r["h"] for r in mine)


@pytest.mark.parametrize("pairs, rho", [([(1, 1), (2, 2), (3, 3)], 1.0), ([(1, 5), (2, 4), (4, 1)], -1.0), ([(3, 1), (3, 2)], None), ([(1, 1), (1, 2), (2, 2), (3, 1)], -1 / 18**0.5)])
def test_spearman(spark, pairs, rho):
    df = spark.createDataFrame([("c", *p) for p in pairs], "k string, x int, y int")
    got = agreement.spearman(df, ["k"], "x", "y").first()["rho"]
    assert got is None if rho is None else got == pytest.approx(rho, abs=1e-9)


def test_keep_first_with_a_hot_group(spark):
    rows = [(i, "copy" if i % 3 else f"text {i}") for i in range(3000)]
    got = sampling.dedup_exact(spark.createDataFrame(rows, "id long, t string"), "t", "id").collect()
    assert len(got) == 1001 and min(r["id"] for r in got if r["t"] == "copy") == 1


def test_normalized_dedup_drops_short(spark):
    rows = [(1, "Hello, World!"), (2, "hello world"), (3, "ok"), (4, "@me hello   WORLD http://x.y")]
    assert [r["id"] for r in sampling.dedup_normalized(spark.createDataFrame(rows, "id int, t string"), "t", "id").collect()] == [1]


def test_folds_and_split_are_balanced(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") < 700, "a").otherwise("b").alias("g"))
    sizes = {(r["g"], r["fold"]): r["count"] for r in sampling.kfold(df, "g", "id").groupBy("g", "fold").count().collect()}
    assert {v for (g, _), v in sizes.items() if g == "a"} == {140} and sum(sizes.values()) == 1003
    split = {(r["g"], r["split"]): r["count"] for r in sampling.dev_test_split(df, "g", "id").groupBy("g", "split").count().collect()}
    assert split[("a", "dev")] == 420 and split[("b", "dev")] == 182


def corpus(spark):
    return spark.range(2000).select(
        "id", F.when(F.col("id") % 10 < 6, "x").when(F.col("id") % 10 < 9, "y").otherwise("z").alias("label"), (F.col("id") % 7 == 0).alias("a"), (F.col("id") % 5 == 0).alias("b"), (F.col("id") < 4).alias("c")
    )


def test_golden_sample_layers(spark):
    rules = {"hard_a": F.col("a"), "hard_b": F.col("b"), "hard_c": F.col("c")}
    out = sampling.golden_sample(corpus(spark), "id", "label", rules, ["x", "y", "z"], n=100, per_rule=10, floor=5).collect()
    assert len(out) == 100 and len({r["id"] for r in out}) == 100
    assert sorted(r["golden_id"] for r in out) == list(range(1, 101))
    layers = {}
    for r in out:
        layers.setdefault(r["sample_layer"], []).append(r)
    assert len(layers["hard_a"]) == 10 and len(layers["hard_b"]) == 10 and all(r["a"] for r in layers["hard_a"]) and all(r["b"] for r in layers["hard_b"])
    base = layers["base"]
    assert len(base) == 100 - sum(len(v) for k, v in layers.items() if k != "base")
    assert min(sum(r["label"] == s for r in base) for s in "xyz") >= 5


def test_hard_tail_equals_the_sequential_draw(spark):
    import hashlib

    rules = {"hard_a": F.col("a"), "hard_b": F.col("b"), "hard_c": F.col("c")}
    got = {r["id"]: r["sample_layer"] for r in sampling.hard_tail(corpus(spark), "id", rules, 10, 42).collect()}
    order = sorted(range(2000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    want, tests = {}, {"hard_a": lambda i: i % 7 == 0, "hard_b": lambda i: i % 5 == 0, "hard_c": lambda i: i < 4}
    for name, test in tests.items():
        want |= {i: name for i in [j for j in order if test(j) and j not in want][:10]}
    assert got == want


def test_random_n_and_share_ratio(spark):
    assert sampling.random_n(spark.range(50), "id", 7).count() == 7 and sampling.random_n(spark.range(3), "id", 7).count() == 3
    s = spark.createDataFrame([("a",), ("b",)], "l string")
    c = spark.createDataFrame([("a",), ("a",), ("a",), ("c",)], "l string")
    assert {tuple(r) for r in profile.share_ratio(s, c, "l").collect()} == {("a", 50.0, 75.0, 1.5), ("b", 50.0, 0.0, 0.0)}


def test_null_groups_and_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2], float(i) if i % 4 else None) for i in range(60)], "id int, g string, v double")
    assert sampling.kfold(df, "g", "id").count() == 60
    split = sampling.dev_test_split(df, "g", "id").groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in split}[(None, "dev")] == 12 and sum(r["count"] for r in split) == 60
    positions = ranks.value_positions(df, ["g"], "v", buckets=4).filter("g is null").collect()
    assert sorted(r["before"] for r in positions) == list(range(15))


def test_describe_keeps_null_groups_and_groups_without_values(spark):
    from threadloom.operators.linking import describe

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "g string, v double")
    got = {r["g"]: (r["median"], r["total"]) for r in describe(df, "v", ["g"]).collect()}
    assert got == {"a": (2.0, 2), "b": (None, 0), None: (5.0, 1)}
    assert describe(df.filter("v is null"), "v").first()["total"] == 0


def test_a_large_stratified_sample_has_its_quotas(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    got = sampling.stratified_sample(df, "g", "id", ["a", "b"], 1500).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 503, "b": 997}
