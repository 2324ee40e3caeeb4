"""Queries that profile tables, and the source and sink round trips (P1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.functions import scoring
from threadloom.functions import values as V
from threadloom.operators import gate, linking, profile, requests
from threadloom.plans import vocab as q
from threadloom.plans.registry import query
from threadloom.plans.threads import tweets
from threadloom.sources import readers
from threadloom.sources.adapters import MINUTES_SQL, order_line_minutes, table
from threadloom.sources.schemas import require_columns
from threadloom.sources.scratch import shared_folder


@query("agg_inventory", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_authors, count(*) - count(DISTINCT event_id) AS n_duplicate_keys FROM events")
def agg_inventory(spark, d):
    return profile.inventory(table(spark, d, "events"), "user_id", "event_id")


@query("agg_value_share", "SELECT event_type, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM events)::DOUBLE * 100, 2) AS pct FROM events GROUP BY 1")
def agg_value_share(spark, d):
    return profile.value_share(table(spark, d, "events"), "event_type")


@query("agg_null_counts", f"WITH {q.T} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_nulls FROM tweets" for c in "tweet_id author_id inbound created_at text response_tweet_id in_response_to_tweet_id".split()))
def agg_null_counts(spark, d):
    return profile.null_counts(tweets(spark, d))


@query("agg_time_range", "SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events")
def agg_time_range(spark, d):
    r = profile.time_range(table(spark, d, "events"), "ts")
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    return r.select(us("first_at").alias("first_us"), us("last_at").alias("last_us"))


@query("agg_describe", f"""SELECT label, min(minutes) AS min, round_even(avg(minutes), 4) AS mean, max(minutes) AS max, count(*) FILTER (minutes < 0) AS negatives, count(minutes) AS total,
round_even(quantile_cont(minutes, 0.25), 6) AS p25, round_even(median(minutes), 6) AS median FROM (SELECT nullif(label, '5-LOW') AS label, CASE WHEN label <> '2-HIGH' THEN minutes END AS minutes FROM ({MINUTES_SQL})) GROUP BY 1""")
def agg_describe(spark, d):
    """One priority counts as unlabelled, one has no values."""
    rows = order_line_minutes(table(spark, d, "orders"), table(spark, d, "lineitem"))
    rows = rows.withColumn("minutes", F.when(F.col("label") != "2-HIGH", F.col("minutes"))).withColumn("label", F.nullif("label", F.lit("5-LOW")))
    return linking.describe(rows, "minutes", ["label"]).withColumns({"mean": F.round("mean", 4), "p25": F.round("p25", 6), "median": F.round("median", 6)})


@query("agg_label_medians", f"""SELECT lower(label) AS intent, round_even(median(minutes), 2) AS median_minutes, (SELECT round_even(median(minutes), 2) FROM ({MINUTES_SQL})) AS global_median FROM ({MINUTES_SQL}) GROUP BY 1""")
def agg_label_medians(spark, d):
    rows = order_line_minutes(table(spark, d, "orders"), table(spark, d, "lineitem"))
    return gate.label_medians(rows, "label", "minutes").withColumn("global_median", gate.global_median(rows, "minutes").scalar())


@query("agg_majority", "SELECT lang AS majority_label, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 1")
def agg_majority(spark, d):
    return profile.mode(table(spark, d, "documents"), "lang")


@query("agg_share_ratio", """WITH s AS (SELECT lang, count(*) * 100 / sum(count(*)) OVER () AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1),
c AS (SELECT lang, count(*) * 100 / sum(count(*)) OVER () AS p FROM documents GROUP BY 1)
SELECT s.lang, round_even(s.p, 2) AS sample_pct, round_even(coalesce(c.p, 0), 2) AS corpus_pct, round_even(coalesce(c.p, 0) / s.p, 2) AS ratio FROM s LEFT JOIN c USING (lang)""")
def agg_share_ratio(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return profile.share_ratio(docs.join(table(spark, d, "labels"), "doc_id", "left_semi"), docs, "lang")


@query("srt_top_authors", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 30")
def srt_top_authors(spark, d):
    return profile.top_values(table(spark, d, "events"), "user_id", 30)


@query("srt_head_n", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 25")
def srt_head_n(spark, d):
    return profile.head(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 25)


@query("srt_lowest", "SELECT event_id, value FROM events ORDER BY value ASC NULLS LAST, event_id LIMIT 1")
def srt_lowest(spark, d):
    return profile.lowest(table(spark, d, "events").select("event_id", "value"), "value", "event_id")


@query("srt_inspect", "SELECT event_id, event_type FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 15")
def srt_inspect(spark, d):
    return profile.inspect_sample(table(spark, d, "events").select("event_id", "event_type"), "event_id", 15, 7)


@query("jon_labels_inner", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def jon_labels_inner(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")


@query("jon_dict_default", "SELECT doc_id, round_even(greatest(0, least(1, (CASE lang WHEN 'en' THEN 101.7 WHEN 'fr' THEN 41.58 WHEN 'de' THEN 64.48 ELSE 72.98 END::DOUBLE - 35) / 70)), 4) AS intent_risk FROM documents")
def jon_dict_default(spark, d):
    known = {k: v for k, v in q.LANG_MEDIANS.items() if k != "es"}
    docs = table(spark, d, "documents").select("doc_id", "lang", "text").withColumn("severity", F.lit("routine"))
    return gate.sla_risk(docs, "lang", "text", "severity", gate.fixed_medians(docs, known)).select("doc_id", "intent_risk")


def _manifest(spark, d):
    """A split manifest written from the labels table: toxic rows are test, the others dev."""
    ids = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "test").otherwise("dev").alias("split"), F.col("doc_id").alias("id"))
    path = f"{shared_folder(spark)}/tables/manifest-{uuid.uuid4().hex}"
    readers.write_id_manifest(ids, path, chunk=100)
    return readers.read_id_manifest(spark, path)


def _golden(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("golden_id"), F.col("text").alias("customer_text"), F.col("lang").alias("intent"),
        F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("escalate"), F.col("source").alias("escalate_reason"),
    )


@query("src_manifest_split", "SELECT doc_id AS golden_id, lang AS intent FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def src_manifest_split(spark, d):
    test_ids = _manifest(spark, d).filter("split = 'test'").select(F.col("id").alias("golden_id"))
    return readers.load_split(_golden(spark, d), "golden_set.csv", test_ids).select("golden_id", "intent")


@query("jon_semi_split", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jon_semi_split(spark, d):
    known = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("golden_id"))
    out = readers.load_split(table(spark, d, "documents").select(F.col("doc_id").alias("golden_id"), "lang"), "all.csv", None, known, ["golden_id"])
    return out.withColumnRenamed("golden_id", "doc_id")


@query("jon_anti_split", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon_anti_split(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("set_except", "SELECT user_id, event_type FROM events EXCEPT SELECT o_custkey, 'view' FROM orders")
def set_except(spark, d):
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("view").alias("event_type"))
    return table(spark, d, "events").select("user_id", "event_type").subtract(buyers)


@query("set_intersect", "SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return table(spark, d, "events").select("user_id").intersect(buyers)


@query("set_union_train", "SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def set_union_train(spark, d):
    """SRC4, SET1: two labelled files written as CSV, read back with declared types and united."""
    root = f"{shared_folder(spark)}/tables/train-{uuid.uuid4().hex}"
    cols = ["origin", "id", "text"]
    parts = {
        "a": table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"),
        "b": table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text"),
    }
    for name, df in parts.items():
        readers.write_csv(df, f"{root}/{name}")
    return readers.read_labelled_csvs(spark, [f"{root}/a", f"{root}/b", f"{root}/absent"], "origin string, id long, text string", cols)


@query("snk_roundtrip", f"WITH {q.T} SELECT * FROM tweets")
def snk_roundtrip(spark, d):
    """SRC1-SRC2, SNK1-SNK2: CSV out and in with declared types, then parquet out and in."""
    root = f"{shared_folder(spark)}/tables/trip-{uuid.uuid4().hex}"
    readers.write_csv(tweets(spark, d), f"{root}/csv")
    readers.write_parquet(readers.read_tweets_csv(spark, f"{root}/csv"), f"{root}/parquet")
    return readers.read_parquet(spark, f"{root}/parquet")


@query("snk_metrics_json", "SELECT event_type, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM events)::DOUBLE * 100, 2) AS pct FROM events GROUP BY 1")
def snk_metrics_json(spark, d):
    """SNK3: a metric frame as JSON, read back with its schema."""
    path = f"{shared_folder(spark)}/tables/metrics-{uuid.uuid4().hex}"
    readers.write_json(profile.value_share(table(spark, d, "events"), "event_type"), path)
    return spark.read.schema("event_type string, n long, pct double").json(path)


@query("src_threads_choice", f"WITH {q.THREADS} SELECT customer_tweet_id, brand_tweet_id, thread_length, round_even(response_time_minutes, 6) AS response_time_minutes FROM threads")
def src_threads_choice(spark, d):
    """SRC3: the full table is read when there is no subsample."""
    root = f"{shared_folder(spark)}/tables/threads-{uuid.uuid4().hex}"
    readers.write_parquet(linking.threads(tweets(spark, d)), f"{root}/full")
    t = readers.read_threads(spark, f"{root}/sub", f"{root}/full")
    return t.select("customer_tweet_id", "brand_tweet_id", F.col("thread_length").cast("bigint"), F.round("response_time_minutes", 6).alias("response_time_minutes"))


@query("src_threads_subsample", f"WITH {q.THREADS} SELECT customer_tweet_id, brand_tweet_id FROM threads WHERE has_followup")
def src_threads_subsample(spark, d):
    """SRC3: the subsample is read when there is one, here the threads with a follow-up."""
    root = f"{shared_folder(spark)}/tables/threads-{uuid.uuid4().hex}"
    every = linking.threads(tweets(spark, d))
    readers.write_parquet(every, f"{root}/full")
    readers.write_parquet(every.filter("has_followup"), f"{root}/sub")
    return readers.read_threads(spark, f"{root}/sub", f"{root}/full").select("customer_tweet_id", "brand_tweet_id")


@query("src_required_columns", "SELECT count(*) AS n, true AS rejected FROM documents JOIN labels USING (doc_id)")
def src_required_columns(spark, d):
    """SRC6: the complete table passes, the same table without two columns is refused before any job."""
    good = require_columns(_golden(spark, d), V.REQUIRED_EVALUATION_COLUMNS)
    try:
        require_columns(good.drop("escalate", "intent"), V.REQUIRED_EVALUATION_COLUMNS)
        rejected = False
    except ValueError:
        rejected = True
    return good.agg(F.count(F.lit(1)).alias("n"), F.lit(rejected).alias("rejected"))


PROMPT_SQL = "'Classify the inquiry.' || chr(10) || '1. role: ' || role || chr(10) || '2. turn: ' || turn || chr(10) || 'INQUIRY: ' || text"
KEY_SQL = f"sha256('model-a' || ':::' || '0.0' || ':::' || CASE WHEN role = 'user' THEN 'You are a classifier.' ELSE '' END || ':::' || {PROMPT_SQL})"


def _requests(spark, d):
    c = table(spark, d, "conversations")
    evidence = F.array(F.concat(F.lit("role: "), "role"), F.concat(F.lit("turn: "), F.col("turn").cast("string")))
    prompt = scoring.render_request("Classify the inquiry.\n", evidence, "%d. %s\n", F.concat(F.lit("INQUIRY: "), "text"))
    return requests.keyed(
        c.select("conv_id", "turn", "role", "text", F.lit("model-a").alias("model"), F.lit("0.0").alias("temperature"), F.when(F.col("role") == "user", "You are a classifier.").alias("system_prompt"), prompt.alias("prompt"))
    )


@query("prj_request_render", f"SELECT conv_id, turn, {PROMPT_SQL} AS prompt FROM conversations")
def prj_request_render(spark, d):
    return _requests(spark, d).select("conv_id", "turn", "prompt")


@query("prj_request_key", f"SELECT conv_id, turn, {KEY_SQL} AS key FROM conversations")
def prj_request_key(spark, d):
    return _requests(spark, d).select("conv_id", "turn", "key")


# Stored answers exist for texts under 500 characters; answers to very short texts lack a field.
RESPONSE_SQL = "'```json' || chr(10) || CASE WHEN length(text) < 150 THEN '{\"intent\": \"x\"}' ELSE '{\"intent\": \"' || role || '\", \"confidence\": ' || round_even(length(text) / 1000::DOUBLE, 4) || '}' END || chr(10) || '```'"


@query("jon_response_cache", "SELECT count(*) FILTER (length(text) < 500) AS cache_hits, count(*) FILTER (length(text) >= 500) AS cache_misses, count(*) FILTER (length(text) < 150) AS parse_fallbacks FROM conversations")
def jon_response_cache(spark, d):
    """SRC8, JON15, AGG32: requests against a keyed store on disk, then parsed and audited."""
    req = _requests(spark, d)
    path = f"{shared_folder(spark)}/tables/store-{uuid.uuid4().hex}"
    body = F.when(F.char_length("text") < 150, F.lit('{"intent": "x"}')).otherwise(
        F.concat(F.lit('{"intent": "'), "role", F.lit('", "confidence": '), F.round(F.char_length("text") / 1000, 4).cast("string"), F.lit("}"))
    )
    known = req.filter(F.char_length("text") < 500).select("key", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"))
    store = requests.ResponseStore(spark, path, buckets=8)
    # Answers that are no JSON come first and are replaced; then what is not stored yet is appended.
    store.append(known.filter(F.crc32("key") % 2 == 0).select("key", F.lit("none").alias("response")))
    store.append(known.filter(F.crc32("key") % 2 == 0))
    store.append(requests.misses(known, store.read()))
    answers = requests.lookup(req, store.rows())
    return requests.audit(requests.parsed(answers, "intent string, confidence double", ["intent", "confidence"]))


@query("prj_response_parse", """SELECT event_id, greatest(1, least(5, coalesce(trunc(try_cast(json_extract_string(props, '$.k') AS DOUBLE))::INT, 3)))::BIGINT AS score,
json_extract_string(props, '$.k') IS NOT NULL AS parse_ok FROM events""")
def prj_response_parse(spark, d):
    fenced = table(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("response"))
    out = requests.parsed(fenced, "k string", ["k"])
    return out.select("event_id", scoring.clamp_score(F.col("parsed.k")).cast("bigint").alias("score"), "parse_ok")
