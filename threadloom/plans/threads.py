"""Queries on message threads (P1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import linking, profile
from threadloom.plans import vocab as q
from threadloom.plans.registry import query
from threadloom.sources.adapters import conversation_tweets, table


def tweets(spark, d):
    return conversation_tweets(table(spark, d, "conversations"))


def followed(spark, d):
    t = tweets(spark, d)
    return linking.with_followups(linking.tagged_pairs(t), t)


def all_threads(spark, d):
    return linking.threads(tweets(spark, d))


@query("prj_pointer_explode", f"WITH {q.T}, {q.PTR} SELECT tweet_id, inbound, position, target_id, (SELECT count(*) FROM tweets WHERE contains(response_tweet_id, ',')) AS n_multi FROM ptr")
def prj_pointer_explode(spark, d):
    t = tweets(spark, d)
    n = linking.multi_pointers(t).agg(F.count(F.lit(1))).scalar()
    return linking.explode_pointers(t).select("tweet_id", "inbound", F.col("position").cast("bigint"), "target_id", n.alias("n_multi"))


@query("jon_forward", f"WITH {q.PAIRS} SELECT c AS customer_tweet_id, b AS brand_tweet_id, a AS brand_author_id FROM fwd")
def jon_forward(spark, d):
    return linking.forward_links(tweets(spark, d))


@query("jon_reverse", f"WITH {q.PAIRS} SELECT c AS customer_tweet_id, b AS brand_tweet_id, a AS brand_author_id FROM rev")
def jon_reverse(spark, d):
    return linking.reverse_links(tweets(spark, d))


@query("jon_pairs_tagged", f"WITH {q.PAIRS} SELECT * FROM pairs")
def jon_pairs_tagged(spark, d):
    return linking.tagged_pairs(tweets(spark, d))


@query("jon_followups", f"WITH {q.FOLLOWED} SELECT customer_tweet_id, brand_tweet_id, has_followup, followup_text, followup_count, thread_length FROM followed")
def jon_followups(spark, d):
    return followed(spark, d).select(
        "customer_tweet_id", "brand_tweet_id", "has_followup", "followup_text", F.col("followup_count").cast("bigint"), F.col("thread_length").cast("bigint")
    )


@query("jon_followups_same_author", f"""WITH {q.PAIRS},
kids AS (SELECT {q.PARENT} AS parent, author_id, count(*) AS n FROM tweets WHERE inbound AND in_response_to_tweet_id IS NOT NULL GROUP BY 1, 2)
SELECT customer_tweet_id, brand_tweet_id, coalesce(n, 0) AS followup_count FROM pairs LEFT JOIN kids ON parent = brand_tweet_id AND author_id = customer_author_id""")
def jon_followups_same_author(spark, d):
    t = tweets(spark, d)
    return linking.with_followups(linking.tagged_pairs(t), t, same_author=True).select(
        "customer_tweet_id", "brand_tweet_id", F.col("followup_count").cast("bigint")
    )


@query("jon_threads", f"WITH {q.THREADS} SELECT * REPLACE (round_even(response_time_minutes, 6) AS response_time_minutes) FROM threads")
def jon_threads(spark, d):
    return all_threads(spark, d).withColumn("thread_length", F.col("thread_length").cast("bigint")).withColumn(
        "response_time_minutes", F.round("response_time_minutes", 6)
    )


@query("jon_thread_trace", f"""WITH RECURSIVE {q.T},
links AS (SELECT t.tweet_id, p.tweet_id AS parent FROM (SELECT tweet_id, {q.PARENT} AS parent FROM tweets) t LEFT JOIN tweets p ON t.parent = p.tweet_id),
walk AS (SELECT tweet_id, tweet_id AS root_id, 0::BIGINT AS depth FROM links WHERE parent IS NULL
  UNION ALL SELECT l.tweet_id, w.root_id, w.depth + 1 FROM links l JOIN walk w ON l.parent = w.tweet_id)
SELECT tweet_id, root_id, depth FROM walk""")
def jon_thread_trace(spark, d):
    return linking.thread_trace(tweets(spark, d))


@query("flt_usable_threads", f"WITH {q.THREADS} SELECT customer_tweet_id, brand_tweet_id, has_followup, followup_text FROM threads WHERE {q.USABLE}")
def flt_usable_threads(spark, d):
    return linking.usable(all_threads(spark, d), q.FOLLOWUP).select("customer_tweet_id", "brand_tweet_id", "has_followup", "followup_text")


@query("agg_author_overlap", f"""WITH {q.T} SELECT (SELECT count(DISTINCT author_id) FROM tweets WHERE NOT inbound) AS brand_authors,
(SELECT count(DISTINCT author_id) FROM tweets WHERE inbound) AS customer_authors,
(SELECT count(*) FROM (SELECT author_id FROM tweets WHERE inbound INTERSECT SELECT author_id FROM tweets WHERE NOT inbound)) AS overlap""")
def agg_author_overlap(spark, d):
    return profile.author_overlap(tweets(spark, d))


@query("agg_link_coverage", f"""WITH {q.T}, {q.PTR},
f AS (SELECT position, b.tweet_id IS NOT NULL AS ok, coalesce(NOT b.inbound, false) AS brand FROM ptr p LEFT JOIN tweets b ON p.target_id = b.tweet_id WHERE p.inbound),
r AS (SELECT c.tweet_id AS hit FROM (SELECT {q.PARENT} AS parent FROM tweets WHERE NOT inbound AND in_response_to_tweet_id IS NOT NULL) t LEFT JOIN tweets c ON t.parent = c.tweet_id)
SELECT (SELECT count(*) FROM tweets WHERE inbound) AS inbound_tweets, (SELECT count(*) FROM tweets WHERE inbound AND response_tweet_id IS NOT NULL) AS inbound_with_pointer,
(SELECT count(*) FROM f) AS forward_ids, (SELECT count(*) FROM f WHERE ok) AS forward_ids_resolved, (SELECT count(*) FROM f WHERE ok AND position = 0) AS forward_first_resolved,
(SELECT count(*) FROM f WHERE brand AND position = 0) AS forward_first_is_brand, (SELECT count(*) FROM r) AS backward_ids, (SELECT count(hit) FROM r) AS backward_resolved""")
def agg_link_coverage(spark, d):
    return linking.link_coverage(tweets(spark, d))


@query("agg_join_source", f"WITH {q.PAIRS} SELECT join_source, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM pairs)::DOUBLE * 100, 2) AS pct FROM pairs GROUP BY 1")
def agg_join_source(spark, d):
    return linking.pair_sources(linking.tagged_pairs(tweets(spark, d)))


@query("agg_followup_rate", f"WITH {q.FOLLOWED} SELECT count(*) AS n_pairs, count(*) FILTER (has_followup) AS n_followups, round_even(count(*) FILTER (has_followup) / count(*)::DOUBLE * 100, 2) AS followup_pct FROM followed")
def agg_followup_rate(spark, d):
    return linking.followup_rate(followed(spark, d))


@query("agg_group_comparison", f"""WITH {q.FOLLOWED} SELECT brand_author_id, count(*) AS volume_pairs, count(DISTINCT customer_tweet_id) AS unique_inbound_tweets,
round_even(avg(has_followup::INT) * 100, 2) AS followup_rate_pct, count(*) FILTER ({q.has('customer_text', q.FOLLOWUP)}) AS escalation_count,
round_even(count(*) FILTER ({q.has('customer_text', q.FOLLOWUP)}) / count(*)::DOUBLE * 100, 2) AS escalation_pct,
trunc(median(length(customer_text)))::BIGINT AS median_customer_len, trunc(median(length(brand_reply_text)))::BIGINT AS median_brand_len, round_even(1 + avg(has_followup::INT), 2) AS avg_thread_depth
FROM followed GROUP BY 1 ORDER BY volume_pairs DESC, brand_author_id LIMIT 15""")
def agg_group_comparison(spark, d):
    return linking.group_comparison(followed(spark, d), words=q.FOLLOWUP)


@query("agg_thread_summary", f"""WITH {q.THREADS} SELECT count(*) AS total_threads, count(*) FILTER ({q.USABLE}) AS usable_threads, round_even(count(*) FILTER ({q.USABLE}) / count(*)::DOUBLE * 100, 2) AS usable_percentage,
count(*) FILTER (has_followup) AS has_followup_count,
'customer_tweet_id,customer_text,customer_created_at,brand_tweet_id,brand_reply_text,brand_reply_created_at,has_followup,followup_text,thread_length,response_time_minutes' AS columns FROM threads""")
def agg_thread_summary(spark, d):
    return linking.thread_summary(all_threads(spark, d), q.FOLLOWUP)


@query("agg_thread_minutes", f"""WITH {q.THREADS} SELECT min(response_time_minutes) AS min, round_even(avg(response_time_minutes), 6) AS mean, max(response_time_minutes) AS max,
count(*) FILTER (response_time_minutes < 0) AS negatives, count(*) AS total, round_even(quantile_cont(response_time_minutes, 0.25), 6) AS p25, round_even(median(response_time_minutes), 6) AS median FROM threads""")
def agg_thread_minutes(spark, d):
    out = linking.describe(all_threads(spark, d), "response_time_minutes")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p25", "median")})


@query("ret_index_report", f"""WITH {q.THREADS}, f AS (SELECT trim(brand_reply_text) <> '' AS replied, has_followup AND {q.FRUSTRATED} AS bad FROM threads)
SELECT count(*) AS total_threads, count(*) FILTER (replied AND NOT bad) AS usable_threads, round_even(count(*) FILTER (replied AND NOT bad) / count(*)::DOUBLE * 100, 2) AS usable_percentage,
count(*) FILTER (NOT (replied AND NOT bad)) AS excluded_threads, count(*) FILTER (NOT replied) AS no_brand_reply, count(*) FILTER (bad) AS frustrated_followup FROM f""")
def ret_index_report(spark, d):
    return linking.index_report(all_threads(spark, d), q.FOLLOWUP)


@query("set_pair_keys", f"WITH {q.PAIRS} SELECT c AS customer_tweet_id, b AS brand_tweet_id FROM (SELECT c, b FROM fwd UNION SELECT c, b FROM rev)")
def set_pair_keys(spark, d):
    t = tweets(spark, d)
    keys = ["customer_tweet_id", "brand_tweet_id"]
    return linking.forward_links(t).select(*keys).union(linking.reverse_links(t).select(*keys)).distinct()
