"""Rebuilding threads from message tables that carry forward and backward pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.lexicon import mentions
from threadloom.functions.scoring import minutes_between, parse_created_at, pointer_ids, rounded
from threadloom.operators.ranks import grouped_quantiles, join_null_safe
from threadloom.sources.scratch import cut_lineage


def explode_pointers(tweets: DataFrame) -> DataFrame:
    """PRJ11: one row per forward pointer, with its place in the list."""
    return tweets.select(
        "tweet_id", "inbound", F.posexplode(pointer_ids(F.col("response_tweet_id"))).alias("position", "target_id")
    )


def multi_pointers(tweets: DataFrame) -> DataFrame:
    """FLT11: messages that list more than one reply."""
    return tweets.filter(F.contains("response_tweet_id", F.lit(",")))


def forward_candidates(tweets: DataFrame) -> DataFrame:
    return explode_pointers(tweets.filter("inbound")).select(
        F.col("tweet_id").alias("customer_tweet_id"), F.col("target_id").alias("brand_tweet_id")
    )


def reverse_candidates(tweets: DataFrame) -> DataFrame:
    parent = F.try_element_at(pointer_ids(F.col("in_response_to_tweet_id")), F.lit(1))
    return tweets.filter("NOT inbound").select(parent.alias("customer_tweet_id"), F.col("tweet_id").alias("brand_tweet_id")).filter(
        "customer_tweet_id IS NOT NULL"
    )


def _side(tweets: DataFrame, inbound: bool, names: Sequence[str]) -> DataFrame:
    cond = F.col("inbound") if inbound else ~F.col("inbound")
    source = ["tweet_id", "author_id", "text", "created_at"]
    return tweets.filter(cond).select(*[F.col(s).alias(n) for s, n in zip(source, names)])


CUSTOMER = ["customer_tweet_id", "customer_author_id", "customer_text", "customer_created_at"]
BRAND = ["brand_tweet_id", "brand_author_id", "brand_reply_text", "brand_reply_created_at"]


def forward_links(tweets: DataFrame) -> DataFrame:
    """JON1, SET5: distinct (customer message, listed reply that exists and is a brand's)."""
    brands = tweets.filter("NOT inbound").select(F.col("tweet_id").alias("brand_tweet_id"), F.col("author_id").alias("brand_author_id"))
    return forward_candidates(tweets).distinct().join(brands, "brand_tweet_id")


def reverse_links(tweets: DataFrame) -> DataFrame:
    """JON2, SET5: distinct (parent that is a customer's, brand reply)."""
    parents = tweets.filter("inbound").select(F.col("tweet_id").alias("customer_tweet_id"))
    authors = tweets.filter("NOT inbound").select(F.col("tweet_id").alias("brand_tweet_id"), F.col("author_id").alias("brand_author_id"))
    return reverse_candidates(tweets).distinct().join(parents, "customer_tweet_id", "left_semi").join(authors, "brand_tweet_id")


def tagged_pairs(tweets: DataFrame) -> DataFrame:
    """JON1-JON4, SET2: every linked (customer, brand) pair once, with its link class and both sides' columns.

    A pair is valid, whichever pointer names it, when its customer id is an inbound message and its brand id
    an outbound one.  So both pointer sets are united and combined by one aggregation, and the two joins
    that fetch the texts are also the validity checks: no full outer join and no separate lookups.
    The right sides are unique on their key, so adaptive skew splitting applies to a hot parent.
    """
    tag = lambda df, f, r: df.select("*", F.lit(f).alias("fwd"), F.lit(r).alias("rev"))
    links = (
        tag(forward_candidates(tweets), True, False)
        .unionByName(tag(reverse_candidates(tweets), False, True))
        .groupBy("customer_tweet_id", "brand_tweet_id")
        .agg(F.max("fwd").alias("fwd"), F.max("rev").alias("rev"))
    )
    source = F.when(F.col("fwd") & F.col("rev"), "both").when(F.col("fwd"), "forward_only").otherwise("reverse_only")
    return (
        links.join(_side(tweets, True, CUSTOMER), "customer_tweet_id")
        .join(_side(tweets, False, BRAND), "brand_tweet_id")
        .select(*CUSTOMER, *BRAND, source.alias("join_source"))
    )


def with_followups(pairs: DataFrame, tweets: DataFrame, same_author: bool = False) -> DataFrame:
    """JON5, WIN2, PRJ13: flag, first text and number of inbound messages that answer the brand reply.

    Children are combined per parent before the join, so a reply with a huge number of answers costs one row.
    First means earliest by (time, id), messages without a readable time last.  `same_author` counts only answers by the pair's own customer.
    """
    parent = F.try_element_at(pointer_ids(F.col("in_response_to_tweet_id")), F.lit(1))
    at = parse_created_at(F.col("created_at"))
    order = F.struct(at.isNull().alias("unknown"), at.alias("at"), F.col("tweet_id"))
    keys = ["brand_tweet_id"] + (["customer_author_id"] if same_author else [])
    children = (
        tweets.filter(F.col("inbound") & F.col("in_response_to_tweet_id").isNotNull())
        .select(parent.alias("brand_tweet_id"), F.col("author_id").alias("customer_author_id"), "text", order.alias("order"))
        .groupBy(*keys)
        .agg(F.min_by("text", "order").alias("followup_text"), F.count(F.lit(1)).cast("int").alias("followup_count"))
    )
    n = F.coalesce("followup_count", F.lit(0))
    return pairs.join(children, keys, "left").select(
        *pairs.columns, (n > 0).alias("has_followup"), "followup_text", n.alias("followup_count"), (n + 1).alias("thread_length")
    )


def response_minutes(pairs: DataFrame) -> DataFrame:
    """PRJ9, PRJ10 on a pair frame."""
    start, end = (parse_created_at(F.col(c)) for c in ("customer_created_at", "brand_reply_created_at"))
    return pairs.withColumn("response_time_minutes", minutes_between(start, end))


def threads(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """The ten-column threads table, of one brand or of all."""
    pairs = tagged_pairs(tweets)
    if brand is not None:
        pairs = pairs.filter(F.col("brand_author_id") == brand)
    out = response_minutes(with_followups(pairs, tweets))
    return out.select(
        "customer_tweet_id", "customer_text", "customer_created_at", "brand_tweet_id", "brand_reply_text",
        "brand_reply_created_at", "has_followup", "followup_text", "thread_length", "response_time_minutes",
    )


def usable(df: DataFrame, words: Sequence[str] = tuple(V.FRUSTRATION_WORDS_INDEX)) -> DataFrame:
    """FLT1: threads with a reply whose follow-up, if any, shows no frustration."""
    return df.filter(has_reply(df) & ~frustrated_followup(df, words))


def has_reply(df: DataFrame):
    return F.coalesce(F.trim(df["brand_reply_text"]) != "", F.lit(False))


def frustrated_followup(df: DataFrame, words: Sequence[str]):
    return df["has_followup"] & mentions(df["followup_text"], words)


def thread_summary(df: DataFrame, words: Sequence[str] = tuple(V.FRUSTRATION_WORDS_INDEX)) -> DataFrame:
    """AGG12: total, usable, usable percentage, follow-ups and column list in one pass."""
    ok = has_reply(df) & ~frustrated_followup(df, words)
    return df.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.count_if(ok).alias("usable_threads"),
        rounded(F.count_if(ok) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 2).alias("usable_percentage"),
        F.count_if("has_followup").alias("has_followup_count"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def index_report(df: DataFrame, words: Sequence[str] = tuple(V.FRUSTRATION_WORDS_INDEX)) -> DataFrame:
    """SNK5: what an index build keeps and why it leaves rows out."""
    replied, bad = has_reply(df), frustrated_followup(df, words)
    return df.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.count_if(replied & ~bad).alias("usable_threads"),
        rounded(F.count_if(replied & ~bad) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 2).alias("usable_percentage"),
        F.count_if(~(replied & ~bad)).alias("excluded_threads"),
        F.count_if(~replied).alias("no_brand_reply"),
        F.count_if(bad).alias("frustrated_followup"),
    )


def pair_sources(pairs: DataFrame) -> DataFrame:
    """AGG8: pairs and share per link class."""
    from threadloom.operators.profile import value_share

    return value_share(pairs, "join_source")


def followup_rate(pairs: DataFrame) -> DataFrame:
    """AGG9."""
    n, k = F.count(F.lit(1)), F.count_if("has_followup")
    return pairs.agg(n.alias("n_pairs"), k.alias("n_followups"), rounded(F.try_divide(k, n) * 100, 2).alias("followup_pct"))


def group_comparison(
    pairs: DataFrame, group: str = "brand_author_id", top: int = 15, words: Sequence[str] = tuple(V.GROUP_ESCALATION_WORDS)
) -> DataFrame:
    """AGG10, SRT2: volume, distinct customers, follow-up and lexicon rates, median lengths, depth per group.

    Distinct customers are counted apart: beside them Spark would key the medians' buffers by (group, customer).
    The top groups are a bounded sort.  Median lengths use the built-in exact median, whose buffer has one entry per
    distinct length.
    """
    n = F.count(F.lit(1))
    hits = F.count_if(mentions(F.col("customer_text"), words))
    rate = F.count_if("has_followup") / n
    customers = pairs.select(group, "customer_tweet_id").distinct().groupBy(group).agg(F.count("customer_tweet_id").alias("unique_inbound_tweets"))
    facts = (
        pairs.groupBy(group)
        .agg(
            n.alias("volume_pairs"),
            rounded(rate * 100, 2).alias("followup_rate_pct"),
            hits.alias("escalation_count"),
            rounded(hits / n * 100, 2).alias("escalation_pct"),
            F.median(F.char_length("customer_text")).cast("bigint").alias("median_customer_len"),
            F.median(F.char_length("brand_reply_text")).cast("bigint").alias("median_brand_len"),
            rounded(1 + rate, 2).alias("avg_thread_depth"),
        )
        .orderBy(F.desc("volume_pairs"), group)
        .limit(top)
    )
    columns = [group, "volume_pairs", "unique_inbound_tweets", *facts.columns[2:]]
    return join_null_safe(facts, customers, [group]).select(*columns)


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG11, FLT15: min, quartile, median, mean, max and the number of negatives, exact at any size.

    A group without values has NULL figures and the total 0; NULL is a group like any other.
    """
    q = grouped_quantiles(df, by, value, {"p25": 0.25, "median": 0.5})
    rest = df.groupBy(*by).agg(
        F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"),
        F.count_if(F.col(value) < 0).alias("negatives"),
    )
    if by:
        counted = join_null_safe(rest, q, list(by), "left")
    else:  # both sides are one-row aggregates
        one = F.lit(1).alias("_one")
        counted = rest.select("*", one).join(q.select("*", one), "_one", "left").drop("_one")
    return counted.withColumn("total", F.coalesce("total", F.lit(0)))


def link_coverage(tweets: DataFrame) -> DataFrame:
    """AGG7, JON11: how many pointers exist, resolve, and resolve to a brand, in both directions.

    Pointers are resolved by one left join on the target id; per-message facts are combined by id first.
    """
    ids = tweets.select(F.col("tweet_id").alias("target_id"), (~F.col("inbound")).alias("is_brand"))
    forward = (
        explode_pointers(tweets.filter("inbound"))
        .join(ids, "target_id", "left")
        .agg(
            F.count(F.lit(1)).alias("forward_ids"),
            F.count_if(F.col("is_brand").isNotNull()).alias("forward_ids_resolved"),
            F.count_if((F.col("position") == 0) & F.col("is_brand").isNotNull()).alias("forward_first_resolved"),
            F.count_if((F.col("position") == 0) & F.col("is_brand")).alias("forward_first_is_brand"),
        )
    )
    backward = reverse_candidates(tweets).join(
        ids.select(F.col("target_id").alias("customer_tweet_id"), "is_brand"), "customer_tweet_id", "left"
    ).agg(F.count(F.lit(1)).alias("backward_ids"), F.count(F.col("is_brand")).alias("backward_resolved"))
    base = tweets.agg(
        F.count_if("inbound").alias("inbound_tweets"),
        F.count_if(F.col("inbound") & F.col("response_tweet_id").isNotNull()).alias("inbound_with_pointer"),
    )
    one = F.lit(1).alias("_one")
    return base.select("*", one).join(forward.select("*", one), "_one").join(backward.select("*", one), "_one").drop("_one")


def thread_trace(tweets: DataFrame) -> DataFrame:
    """JON14: the root of every message and its distance from it, following backward pointers that resolve.

    Pointer jumping: each round replaces a message's ancestor by that ancestor's ancestor, so a chain of
    length n takes log2(n) joins.  Finished messages are written once, apart from those still on their way, and
    rounds go on until none finishes.  What is left then is on or behind a pointer cycle, has no root and is left
    out, as in a walk that starts from the roots.
    """
    parent = F.try_element_at(pointer_ids(F.col("in_response_to_tweet_id")), F.lit(1))
    ids = tweets.select(F.col("tweet_id").alias("ancestor_id"))
    links = tweets.select("tweet_id", parent.alias("ancestor_id"))
    found = links.join(ids, "ancestor_id", "left_semi").select("tweet_id", "ancestor_id", F.lit(1).cast("bigint").alias("depth"))
    roots = tweets.select("tweet_id").join(found.select("tweet_id"), "tweet_id", "left_anti")
    roots = roots.select("tweet_id", F.col("tweet_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("depth"))
    finished = [cut_lineage(roots)]
    moving = cut_lineage(found)
    left = moving.count()
    while left:
        end = finished[0]
        for more in finished[1:]:
            end = end.unionByName(more)
        ended = end.select(F.col("tweet_id").alias("ancestor_id"), F.col("ancestor_id").alias("_next"), F.col("depth").alias("_more"), F.lit(True).alias("_done"))
        ahead = moving.select(F.col("tweet_id").alias("ancestor_id"), F.col("ancestor_id").alias("_next"), F.col("depth").alias("_more"), F.lit(False).alias("_done"))
        moved = cut_lineage(
            moving.join(ended.unionByName(ahead), "ancestor_id").select(
                "tweet_id", F.col("_next").alias("ancestor_id"), (F.col("depth") + F.col("_more")).alias("depth"), "_done"
            )
        )
        finished.append(moved.filter("_done").drop("_done"))
        moving = moved.filter("NOT _done").drop("_done")
        before, left = left, moving.count()
        if left == before:
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("tweet_id", F.col("ancestor_id").alias("root_id"), "depth")
