"""Queries that draw samples, folds and splits (P2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import lexicon
from threadloom.operators import sampling
from threadloom.plans import vocab as q
from threadloom.plans.registry import query
from threadloom.sources.adapters import table

STRATA = [*q.LANGS, "other"]


def rank_sql(seed, key="doc_id"):
    return f"md5('{seed}:' || {key}), {key}"


@query("win_random_n", f"SELECT doc_id FROM documents ORDER BY {rank_sql(42)} LIMIT 100")
def win_random_n(spark, d):
    return sampling.random_n(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


def _some_unlabelled(spark, d):
    """Every document; one language counts as unlabelled."""
    return table(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("lang"))


@query("win_kfold", f"SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY {rank_sql(42)}) - 1) % 5)::BIGINT AS fold FROM (SELECT doc_id, nullif(lang, 'es') AS lang FROM documents)")
def win_kfold(spark, d):
    out = sampling.kfold(_some_unlabelled(spark, d), "lang", "doc_id")
    return out.withColumn("fold", F.col("fold").cast("bigint"))


@query("win_split", f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {rank_sql(42)}) <= round(count(*) OVER (PARTITION BY lang) * 0.6::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, nullif(lang, 'es') AS lang FROM documents)")
def win_split(spark, d):
    return sampling.dev_test_split(_some_unlabelled(spark, d), "lang", "doc_id")


QUOTA_SQL = """quota AS (SELECT s, n, q + CASE WHEN row_number() OVER (ORDER BY n DESC, s) = 1 THEN {target} - sum(q) OVER () ELSE 0 END AS quota FROM (
  SELECT s, coalesce(n, 0) AS n, {floor} + round_even(coalesce(n / (SELECT count(*) FROM {src})::DOUBLE, 0) * ({target} - 5 * {floor}), 0)::BIGINT AS q
  FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'other']) AS s) LEFT JOIN (SELECT lang, count(*) AS n FROM {src} GROUP BY 1) ON s = lang))"""


@query("win_stratified_sample", f"""WITH {QUOTA_SQL.format(target=140, floor=10, src='documents')},
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {rank_sql(42)}) AS rn FROM documents) SELECT doc_id, lang FROM r JOIN quota ON lang = s WHERE rn <= quota""")
def win_stratified_sample(spark, d):
    return sampling.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", STRATA, 140)


def _corpus(spark, d):
    """Documents as messages: the label and confidence come from function words, the follow-up is the text itself."""
    label, conf = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    return table(spark, d, "documents").select("doc_id", "lang", "text", (F.col("source") == "src3").alias("has_followup"), label.alias("pseudo"), conf.alias("conf"))


def _rules():
    return sampling.hard_rules("text", "text", "has_followup", "conf", q.GRUMBLES, q.PRAISE, q.TOPICS)


CORPUS_SQL = f"""corpus AS MATERIALIZED (SELECT doc_id, lang, text, source = 'src3' AND {q.has('text', q.GRUMBLES)} AS a, length(text) >= 180 AND ({q.topics('text')}) >= 2 AS b,
{q.case('text', q.LANG_WORDS, 1, q.LANG_DEFAULT[1])} <= 0.4::DOUBLE AS c, {q.has('text', q.PRAISE)} AND {q.has('text', q.GRUMBLES)} AS d, md5('42:' || doc_id) AS h FROM documents),
pa AS MATERIALIZED (SELECT doc_id, 'hard_a' AS sample_layer FROM corpus WHERE a ORDER BY h, doc_id LIMIT 15),
pb AS MATERIALIZED (SELECT doc_id, 'hard_b' AS sample_layer FROM corpus WHERE b AND doc_id NOT IN (SELECT doc_id FROM pa) ORDER BY h, doc_id LIMIT 15),
pc AS MATERIALIZED (SELECT doc_id, 'hard_c' AS sample_layer FROM corpus WHERE c AND doc_id NOT IN (SELECT doc_id FROM pa UNION ALL SELECT doc_id FROM pb) ORDER BY h, doc_id LIMIT 15),
pd AS MATERIALIZED (SELECT doc_id, 'hard_d' AS sample_layer FROM corpus WHERE d AND doc_id NOT IN (SELECT doc_id FROM pa UNION ALL SELECT doc_id FROM pb UNION ALL SELECT doc_id FROM pc) ORDER BY h, doc_id LIMIT 15),
hard AS MATERIALIZED (SELECT * FROM pa UNION ALL SELECT * FROM pb UNION ALL SELECT * FROM pc UNION ALL SELECT * FROM pd)"""


@query("win_hard_tail", f"WITH {CORPUS_SQL} SELECT * FROM hard")
def win_hard_tail(spark, d):
    return sampling.hard_tail(_corpus(spark, d), "doc_id", _rules())


TARGET = "(200 - (SELECT count(*) FROM hard))"


@query("win_golden_set", f"""WITH {CORPUS_SQL}, rest AS MATERIALIZED (SELECT * FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM hard)), {QUOTA_SQL.format(target=TARGET, floor=10, src='rest')},
base AS (SELECT doc_id, 'base' AS sample_layer FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn FROM rest) JOIN quota ON lang = s WHERE rn <= quota),
picked AS (SELECT * FROM hard UNION ALL SELECT * FROM base)
SELECT row_number() OVER (ORDER BY {rank_sql('42:order')}) AS golden_id, doc_id, lang, sample_layer FROM picked JOIN documents USING (doc_id)""")
def win_golden_set(spark, d):
    out = sampling.golden_sample(_corpus(spark, d), "doc_id", "lang", _rules(), STRATA)
    return out.select(F.col("golden_id").cast("bigint"), "doc_id", "lang", "sample_layer")
