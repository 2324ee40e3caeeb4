from pyspark.sql import functions as F

from threadloom.operators import linking
from threadloom.sources.schemas import TWEETS

DAY = "Tue Oct 31 22:{:02d}:00 +0000 2017"


def tweets(spark):
    rows = [
        (1, "c1", True, DAY.format(0), "help", "2,3.0,99", None),
        (2, "B", False, DAY.format(5), "try this", "4", "1"),
        (3, "B", False, DAY.format(6), "also", None, None),
        (4, "c1", True, DAY.format(9), "still bad", None, "2.0"),
        (5, "c2", True, DAY.format(8), "me too", "x", "2"),
        (6, "B", False, DAY.format(20), "sorry", None, " 5 "),
        (7, "c3", True, DAY.format(21), "hi", "4", "77"),
    ]
    return spark.createDataFrame(rows, TWEETS)


def test_pairs_are_tagged_by_source(spark):
    got = {(r["customer_tweet_id"], r["brand_tweet_id"]): r["join_source"] for r in linking.tagged_pairs(tweets(spark)).collect()}
    # 7 -> 4 is no pair: the target is a customer's; 1 -> 99 does not exist.
    assert got == {(1, 2): "both", (1, 3): "forward_only", (5, 6): "reverse_only"}


def test_links_agree_with_tagged_pairs(spark):
    t = tweets(spark)
    assert {tuple(r[:2]) for r in linking.forward_links(t).select("customer_tweet_id", "brand_tweet_id").collect()} == {(1, 2), (1, 3)}
    assert {tuple(r[:2]) for r in linking.reverse_links(t).select("customer_tweet_id", "brand_tweet_id").collect()} == {(1, 2), (5, 6)}


def test_followups_first_by_time(spark):
    t = tweets(spark)
    got = {r["brand_tweet_id"]: (r["has_followup"], r["followup_text"], r["followup_count"], r["thread_length"]) for r in linking.with_followups(linking.tagged_pairs(t), t).collect()}
    assert got == {2: (True, "me too", 2, 3), 3: (False, None, 0, 1), 6: (False, None, 0, 1)}
    same = {r["brand_tweet_id"]: r["followup_text"] for r in linking.with_followups(linking.tagged_pairs(t), t, same_author=True).collect()}
    assert same[2] == "still bad"


def test_threads_and_usability(spark):
    th = linking.threads(tweets(spark), "B")
    assert len(th.columns) == 10
    assert {r["brand_tweet_id"]: r["response_time_minutes"] for r in th.collect()} == {2: 5.0, 3: 6.0, 6: 12.0}
    assert linking.usable(th).count() == 3 and linking.usable(th, ["me too"]).count() == 2
    s = linking.thread_summary(th, ["me too"]).first()
    assert (s["total_threads"], s["usable_threads"], s["usable_percentage"], s["has_followup_count"]) == (3, 2, 66.67, 1)


def test_coverage(spark):
    r = linking.link_coverage(tweets(spark)).first().asDict()
    assert r == {
        "inbound_tweets": 4, "inbound_with_pointer": 3, "forward_ids": 4, "forward_ids_resolved": 3, "forward_first_resolved": 2,
        "forward_first_is_brand": 1, "backward_ids": 2, "backward_resolved": 2,
    }


def test_trace_follows_long_chains_hot_parents_and_skips_cycles(spark):
    chain = [(i, "a", True, "", "", None, str(i - 1) if i else None) for i in range(40)]
    hot = [(1000 + i, "b", True, "", "", None, "39") for i in range(300)]
    cycle = [(5000, "z", True, "", "", None, "5001"), (5001, "z", True, "", "", None, "5000")]
    got = {r["tweet_id"]: (r["root_id"], r["depth"]) for r in linking.thread_trace(spark.createDataFrame(chain + hot + cycle, TWEETS)).collect()}
    want = {i: (0, i) for i in range(40)} | {1000 + i: (0, 40) for i in range(300)}
    assert got == want


def test_describe_without_groups(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    r = linking.describe(df, "v").first()
    assert (r["min"], r["p25"], r["median"], r["max"], r["negatives"]) == (-1.0, 1.25, 3.0, 8.0, 1)


def test_long_ids_stay_exact(spark):
    from threadloom.functions.scoring import pointer_ids

    df = spark.createDataFrame([("9007199254740993, 7.0, x, 123456789012345678",)], "p string")
    assert df.select(pointer_ids(F.col("p")).alias("i")).first()["i"] == [9007199254740993, 7, 123456789012345678]


def test_a_followup_without_a_readable_time_comes_last(spark):
    tweets = spark.createDataFrame(
        [(3, "c", True, "not a time", "later", None, "2"), (4, "c", True, "Tue Oct 31 22:10:47 +0000 2017", "first", None, "2")], TWEETS
    )
    pairs = spark.createDataFrame([(2, "c")], "brand_tweet_id long, customer_author_id string")
    assert linking.with_followups(pairs, tweets).first()["followup_text"] == "first"
