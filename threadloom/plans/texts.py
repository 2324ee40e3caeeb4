"""Queries on texts: normal form, redaction, lexicons, rules, dedup (P2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import lexicon, scoring, text
from threadloom.functions import values as V
from threadloom.operators import profile, sampling
from threadloom.operators.gate import rule_layer
from threadloom.plans import vocab as q
from threadloom.plans.registry import query
from threadloom.sources.adapters import MINUTES_SQL, conversation_tweets, order_line_minutes, table

DEVICE_SRC = "'SN: ' || lpad(doc_id::VARCHAR, 10, 'A') || ' ' || text"


@query("prj_normalize_text", f"SELECT doc_id, {q.normal('text')} AS norm FROM documents")
def prj_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normal_form(F.col("text")).alias("norm"))


def _redacted(source: str, steps: str, name: str = "s") -> str:
    """The redaction as a chain of CTEs, cut after the wanted steps."""
    table_ = {"email": (V.EMAIL_PATTERN, V.EMAIL_TAG), "phone": (V.PHONE_PATTERN, V.PHONE_TAG), "digits": (V.LONG_DIGITS_PATTERN, V.LONG_DIGITS_TAG), "device": ("(?i)" + V.DEVICE_PATTERN, V.DEVICE_TAG)}
    ctes, prev = [f"{name}0 AS ({source})"], f"{name}0"
    for i, s in enumerate(steps.split(), 1):
        p, tag = table_[s]
        ctes.append(f"{name}{i} AS (SELECT * REPLACE (regexp_replace(t, '{p}', '{tag}', 'g') AS t), len(regexp_extract_all(t, '{p}')) AS n_{s} FROM {prev})")
        prev = f"{name}{i}"
    return "WITH " + ", ".join(ctes) + " "


ALL = "email phone digits device"
TYPES = "array_to_string(list_filter([CASE WHEN n_email > 0 THEN 'email' END, CASE WHEN n_phone > 0 THEN 'phone_number' END, CASE WHEN n_digits > 0 THEN 'card_or_account_number' END, CASE WHEN n_device > 0 THEN 'device_identifier' END], lambda x: x IS NOT NULL), ',')"


@query("prj_redact_pii", _redacted("SELECT doc_id, text AS t FROM documents", ALL) + f"SELECT doc_id, t AS redacted_text, (n_email + n_phone + n_digits + n_device)::BIGINT AS pii_count, {TYPES} AS pii_types FROM s4")
def prj_redact_pii(spark, d):
    out = text.redact(table(spark, d, "documents"), "text")
    return out.select("doc_id", "redacted_text", F.col("pii_count").cast("bigint"), F.array_join("pii_types", ",").alias("pii_types"))


def _one_step(step: str):
    @query(f"prj_redact_{step}", _redacted("SELECT doc_id, text AS t FROM documents", step) + f"SELECT doc_id, t AS redacted_text, n_{step}::BIGINT AS pii_count FROM s1")
    def run(spark, d):
        out = text.redact(table(spark, d, "documents"), "text", steps=[step])
        return out.select("doc_id", "redacted_text", F.col("pii_count").cast("bigint"))

    return run


prj_redact_email, prj_redact_phone, prj_redact_digits = (_one_step(s) for s in ("email", "phone", "digits"))


@query("prj_redact_device", _redacted(f"SELECT doc_id, {DEVICE_SRC} AS t FROM documents", "device") + "SELECT doc_id, t AS redacted_text, n_device::BIGINT AS pii_count FROM s1")
def prj_redact_device(spark, d):
    marked = F.concat(F.lit("SN: "), F.lpad(F.col("doc_id").cast("string"), 10, "A"), F.lit(" "), F.col("text"))
    out = text.redact(table(spark, d, "documents").withColumn("text", marked), "text", steps=["device"])
    return out.select("doc_id", "redacted_text", F.col("pii_count").cast("bigint"))


@query("prj_anonymize", _redacted("SELECT page_id, url || ' ' || html AS t FROM pages", ALL) + "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '@[A-Za-z0-9_]+', '@[USER]', 'g'), 'https?://[^\\s\\p{Z}]+', '[URL]', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS anonymized_text FROM s4")
def prj_anonymize(spark, d):
    pages = table(spark, d, "pages").withColumn("body", F.concat_ws(" ", "url", "html"))
    return text.anonymize(pages, "body").select("page_id", "anonymized_text")


@query("prj_text_length_profile", "SELECT role, count(*) AS n, round_even(avg(length(text)), 2) AS mean_len, median(length(text))::DOUBLE AS median_len, max(length(text))::BIGINT AS max_len FROM conversations GROUP BY 1")
def prj_text_length_profile(spark, d):
    out = profile.length_profile(table(spark, d, "conversations"), "text", ["role"])
    return out.withColumn("max_len", F.col("max_len").cast("bigint"))


@query("prj_parse_timestamp", f"WITH {q.T} SELECT tweet_id, epoch_us({q.STAMP.format('created_at')}) AS created_us FROM tweets")
def prj_parse_timestamp(spark, d):
    t = conversation_tweets(table(spark, d, "conversations"))
    return t.select("tweet_id", F.unix_micros(scoring.parse_created_at(F.col("created_at"))).alias("created_us"))


@query("prj_response_minutes", MINUTES_SQL)
def prj_response_minutes(spark, d):
    return order_line_minutes(table(spark, d, "orders"), table(spark, d, "lineitem"))


@query("prj_lexicon_hits", f"SELECT doc_id, ({q.topics('text')})::BIGINT AS n_topics, length(text) >= 180 AND ({q.topics('text')}) >= 2 AS multi_issue FROM documents")
def prj_lexicon_hits(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", lexicon.topics_hit(c, q.TOPICS).cast("bigint").alias("n_topics"), lexicon.multi_issue(c, q.TOPICS).alias("multi_issue"))


@query("flt_rule_table", f"SELECT doc_id, {q.rule_code('text')} AS rule_code, {q.rule_snippet('text')} AS rule_snippet FROM documents")
def flt_rule_table(spark, d):
    return rule_layer(table(spark, d, "documents"), "text", q.RULES).select("doc_id", "rule_code", "rule_snippet")


@query("flt_urgency_sarcasm", f"SELECT doc_id, {q.has('text', q.URGENT)} AS urgent, {q.has('text', q.PRAISE)} AND {q.has('text', q.GRUMBLES)} AS sarcasm_risk FROM documents")
def flt_urgency_sarcasm(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", lexicon.mentions(c, q.URGENT).alias("urgent"), lexicon.sarcasm_risk(c, q.PRAISE, q.GRUMBLES).alias("sarcasm_risk"))


@query("flt_group_lexicon", f"SELECT source, count(*) AS n, count(*) FILTER ({q.has('text', q.INSULTS)}) AS n_hits, count(*) FILTER ({q.has('text', ['er', 'an'], 'substring')}) AS n_substring FROM documents GROUP BY 1")
def flt_group_lexicon(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lexicon.mentions(c, q.INSULTS)).alias("n_hits"), F.count_if(lexicon.mentions(c, ["er", "an"], "substring")).alias("n_substring")
    )


@query("flt_length_confidence_taxonomy", f"""SELECT doc_id, lang, {q.case('text', q.LANG_WORDS, 1, q.LANG_DEFAULT[1])} AS confidence FROM documents
WHERE length({q.normal('text')}) >= 3 AND {q.case('text', q.LANG_WORDS, 1, q.LANG_DEFAULT[1])} <= 0.6::DOUBLE AND lang IN ('en', 'fr', 'de')""")
def flt_length_confidence_taxonomy(spark, d):
    docs = table(spark, d, "documents").filter(F.col("lang").isin("en", "fr", "de"))
    _, conf = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    return docs.select("doc_id", "lang", "text", conf.alias("confidence")).filter(
        (F.col("confidence") <= 0.6) & (F.char_length(text.normal_form(F.col("text"))) >= 3)
    ).select("doc_id", "lang", "confidence")


@query("cls_lexicon", f"SELECT doc_id, {q.case('text', q.LANG_WORDS, 0, q.LANG_DEFAULT[0])} AS label, {q.case('text', q.LANG_WORDS, 1, q.LANG_DEFAULT[1])} AS confidence FROM documents")
def cls_lexicon(spark, d):
    label, conf = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    return table(spark, d, "documents").select("doc_id", label.alias("label"), conf.alias("confidence"))


@query("cls_severity", f"SELECT doc_id, {q.severity('text')} AS severity FROM documents")
def cls_severity(spark, d):
    return table(spark, d, "documents").select("doc_id", lexicon.severity(F.col("text"), q.INSULTS, q.GRUMBLES).alias("severity"))


@query("win_dedup_exact", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_key FROM documents GROUP BY text")
def win_dedup_exact(spark, d):
    out = sampling.dedup_exact(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return out.select("doc_id", text.text_key(F.col("text")).alias("text_key"))


@query("win_dedup_normalized", f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {q.normal('text')} AS norm FROM documents) WHERE length(norm) >= 3 GROUP BY norm")
def win_dedup_normalized(spark, d):
    keyed = sampling.with_normal_key(table(spark, d, "documents").select("doc_id", "text"), "text", 3).select("doc_id", "norm_key")
    first = sampling.keep_first(keyed, F.col("norm_key"), "doc_id")
    return first.join(keyed.groupBy("norm_key").agg(F.count(F.lit(1)).alias("copies")), "norm_key").select("doc_id", "copies")


@query("win_dedup_corpus", f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {q.normal('text')} AS norm FROM documents) WHERE length(norm) >= 3 GROUP BY norm")
def win_dedup_corpus(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sampling.dedup_normalized(docs, "text", "doc_id").select("doc_id")


@query("prj_reply_features", """SELECT conv_id, turn, contains(lower(text), '[escalated') AS escalated, regexp_matches(lower(text), 'settings|reset|update') AS has_settings,
regexp_matches(lower(text), 'dm|direct message') AS has_dm, regexp_matches(lower(text), 'https://|\\.com|t\\.co') AS has_url,
regexp_matches(lower(text), '\\?|what version|which device|front and rear') AS asks_question,
regexp_matches(lower(text), 'settings >|iforgot\\.apple\\.com|reportaproblem\\.apple\\.com|text replacement|network settings|icloud music library|front and rear') AS has_specific_path,
length(text) < 120 AS is_short FROM conversations WHERE role = 'assistant'""")
def prj_reply_features(spark, d):
    replies = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    return replies.select("conv_id", "turn", *[c.alias(n) for n, c in scoring.reply_features(F.col("text")).items()])


@query("prj_flags_clean", """SELECT doc_id, lower(trim(CASE WHEN l.toxic = 1 THEN ' Yes' ELSE 'no ' END)) = 'yes' AS is_toxic,
CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS label, CASE WHEN lang IN ('en', 'fr') THEN round_even(quality * 0.77123::DOUBLE, 4) ELSE 0.5::DOUBLE END AS confidence
FROM labels l JOIN documents USING (doc_id)""")
def prj_flags_clean(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    flag = F.when(F.col("toxic") == 1, " Yes").otherwise("no ")
    label, conf = scoring.known_label(F.col("lang"), F.col("quality") * 0.77123, ["en", "fr"])
    return both.select("doc_id", scoring.yes(flag).alias("is_toxic"), label.alias("label"), conf.alias("confidence"))
