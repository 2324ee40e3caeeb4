"""Queries on features, retrieval, classification and clustering (P3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.functions import lexicon, text
from threadloom.functions import values as V
from threadloom.operators import features, models
from threadloom.operators.linking import threads, usable
from threadloom.operators.retrieval import ThreadIndex, topk_dense
from threadloom.operators.silhouette import plain_silhouette
from threadloom.plans import vocab as q
from threadloom.plans.registry import query
from threadloom.plans.threads import tweets
from threadloom.sources.adapters import table
from threadloom.sources.scratch import shared_folder

STOP_SQL = "'" + "', '".join(q.STOP) + "'"


def toks(col: str, stop: bool = False) -> str:
    t = f"regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"list_filter({t}, lambda x: x NOT IN ({STOP_SQL}))" if stop else t


def grams(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def counts_sql(name: str, source: str, keys: str, col: str, stop: bool) -> str:
    """CTE `name`: keys, term, tf."""
    return f"""{name}_t AS MATERIALIZED (SELECT {keys}, {toks(col, stop)} AS l FROM {source}),
{name} AS MATERIALIZED (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest({grams('l')}) AS term FROM {name}_t) GROUP BY {keys}, term)"""


def vocab_sql(counts: str, source: str, limit: str = "ORDER BY cf DESC, term LIMIT 25000") -> str:
    return f"""vocab AS MATERIALIZED (SELECT term, df, cf, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)::DOUBLE) + 1 AS idf FROM
(SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {counts} GROUP BY term HAVING count(*) >= 2 {limit}))"""


def weights_sql(name: str, counts: str, keys: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {keys}, term, r / sqrt(sum(r * r) OVER (PARTITION BY {keys})) AS w FROM (SELECT {keys}, term, (1 + ln(tf)) * idf AS r FROM {counts} JOIN vocab USING (term)))"


@query("txt_tokens", f"SELECT doc_id, len({toks('text')})::BIGINT AS n, md5(array_to_string({toks('text')}, '|')) AS tokens FROM documents")
def txt_tokens(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, "|")).alias("tokens"))


@query("txt_ngrams", f"WITH t AS (SELECT doc_id, {toks('text', True)} AS l FROM documents) SELECT doc_id, len({grams('l')})::BIGINT AS n, md5(array_to_string({grams('l')}, '|')) AS terms FROM t")
def txt_ngrams(spark, d):
    t = features.terms(F.col("text"), q.STOP)
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, "|")).alias("terms"))


@query("txt_vocab", f"WITH {counts_sql('c', 'documents', 'doc_id', 'text', True)}, {vocab_sql('c', 'documents')} SELECT term, df, cf, round_even(idf, 6) AS idf FROM vocab")
def txt_vocab(spark, d):
    _, vocab = features.fit(table(spark, d, "documents"), "doc_id", "text", q.STOP)
    return vocab.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query("txt_tfidf", f"WITH {counts_sql('c', 'documents', 'doc_id', 'text', True)}, {vocab_sql('c', 'documents')}, {weights_sql('w', 'c', 'doc_id')} SELECT doc_id, count(*) AS n_terms, round_even(sum(w), 6) AS total, round_even(max(w), 6) AS top, round_even(sum(w * length(term)), 5) AS by_length FROM w GROUP BY 1")
def txt_tfidf(spark, d):
    counts, vocab = features.fit(table(spark, d, "documents"), "doc_id", "text", q.STOP)
    w = features.weights(counts, vocab, "doc_id", V.MAX_INDEX_TERMS)
    return w.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum(F.col("weight") * F.char_length("term")), 5).alias("by_length")
    )


@query("txt_transform", f"WITH {counts_sql('c', 'documents', 'doc_id', 'text', True)}, {vocab_sql('c', 'documents')}, {counts_sql('u', 'conversations', 'conv_id, turn', 'text', True)}, {weights_sql('w', 'u', 'conv_id, turn')} SELECT conv_id, turn, count(*) AS n_terms, round_even(sum(w), 6) AS total FROM w GROUP BY 1, 2")
def txt_transform(spark, d):
    _, vocab = features.fit(table(spark, d, "documents"), "doc_id", "text", q.STOP)
    conv = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    w = features.weights(features.packed_counts(conv, "k", "text", q.STOP), vocab, "k", V.MAX_INDEX_TERMS)
    return w.groupBy("k").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("total")).select("k.*", "n_terms", "total")


# ---- retrieval over the threads of the conversations ----------------------------------------------

INDEX = f"""{q.THREADS}, docs AS MATERIALIZED (SELECT brand_tweet_id AS d, customer_tweet_id AS o, customer_text, brand_reply_text FROM threads WHERE {q.USABLE}),
{counts_sql('dc', 'docs', 'd, o', 'customer_text', True)}, {vocab_sql('dc', 'docs')}, {weights_sql('dw', 'dc', 'd, o')},
msgs AS (SELECT tweet_id AS qid, text FROM tweets WHERE inbound), {counts_sql('qc', 'msgs', 'qid', 'text', True)}, {weights_sql('qw', 'qc', 'qid')},
sims AS MATERIALIZED (SELECT qid, d, o, sum(qw.w * dw.w) AS s FROM qw JOIN dw USING (term) WHERE o <> qid GROUP BY ALL HAVING round_even(sum(qw.w * dw.w), 8) >= 0.15::DOUBLE)"""
RANKED = f"{INDEX}, hits AS MATERIALIZED (SELECT qid, d, o, round_even(s, 4) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY round_even(s, 8) DESC, d, o) AS rank FROM sims QUALIFY rank <= 3)"


def message_table(spark, d):
    return tweets(spark, d).filter("inbound").select("tweet_id", "text")


def thread_index(spark, d):
    return ThreadIndex.build(usable(threads(tweets(spark, d)), q.FOLLOWUP), q.STOP)


@query("ret_topk", f"WITH {RANKED} SELECT qid AS tweet_id, rank, d AS brand_tweet_id, o AS customer_tweet_id, similarity FROM hits")
def ret_topk(spark, d):
    out = thread_index(spark, d).query(message_table(spark, d), "tweet_id", "text", exclude_self=True)
    return out.select("tweet_id", F.posexplode("hits").alias("pos", "h")).select(
        "tweet_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "h.brand_tweet_id", "h.customer_tweet_id", "h.similarity"
    )


@query("ret_saved_index", f"""WITH {q.THREADS}, docs AS MATERIALIZED (SELECT brand_tweet_id AS d, customer_tweet_id AS o, customer_text FROM threads WHERE {q.USABLE}),
{counts_sql('dc', 'docs', 'd, o', 'customer_text', True)}, {vocab_sql('dc', 'docs')}, {weights_sql('dw', 'dc', 'd, o')}
SELECT d AS doc_id, o AS owner_id, count(*) AS n_terms, round_even(sum(w), 6) AS total FROM dw GROUP BY 1, 2""")
def ret_saved_index(spark, d):
    """RET1, SNK4: the index written as tables and read back."""
    path = f"{shared_folder(spark)}/tables/index-{uuid.uuid4().hex}"
    thread_index(spark, d).save(path)
    rows = ThreadIndex.load(spark, path).rows
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "owner_id", F.size("weights").cast("bigint").alias("n_terms"), F.round(total, 6).alias("total"))


@query("ret_dense_knn", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.e, b.e) / a.l / b.l AS s FROM n a, n b WHERE a.vec_id <> b.vec_id)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY round_even(s, 8) DESC, neighbour) AS rank, neighbour, round_even(s, 4) AS similarity FROM s WHERE round_even(s, 8) >= 0.15::DOUBLE QUALIFY rank <= 3""")
def ret_dense_knn(spark, d):
    e = table(spark, d, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("owner_id"), F.col("embedding").alias("vector"))
    out = topk_dense(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), docs, exclude_self=True)
    return out.select(F.col("query_id").alias("vec_id"), F.posexplode("hits").alias("pos", "h")).select(
        "vec_id", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("h.doc_id").alias("neighbour"), "h.similarity"
    )


# ---- classifiers and clusters ---------------------------------------------------------------------

SECOND_WORDS = [("es", 0.65, ["por", "para"]), ("fr", 0.55, ["et", "une"]), ("en", 0.50, ["was", "for"]), ("de", 0.35, ["die", "zu"])]


def two_predictions(spark, d):
    a, ac = lexicon.cascade(F.col("text"), q.LANG_WORDS, q.LANG_DEFAULT)
    b, bc = lexicon.cascade(F.col("text"), SECOND_WORDS, ("de", 0.20))
    return table(spark, d, "documents").select("doc_id", a.alias("p1"), ac.alias("c1"), b.alias("p2"), bc.alias("c2"))


TWO_SQL = f"p AS (SELECT doc_id, {q.case('text', q.LANG_WORDS, 0, q.LANG_DEFAULT[0])} AS p1, {q.case('text', q.LANG_WORDS, 1, q.LANG_DEFAULT[1])} AS c1, {q.case('text', SECOND_WORDS, 0, 'de')} AS p2, {q.case('text', SECOND_WORDS, 1, 0.2)} AS c2 FROM documents)"
TAKE = "c1 < 0.5 AND p1 <> p2 AND c2 > c1"


@query("cls_arbitrate", f"WITH {TWO_SQL} SELECT doc_id, CASE WHEN {TAKE} THEN p2 ELSE p1 END AS intent, CASE WHEN {TAKE} THEN c2 ELSE c1 END AS confidence, CASE WHEN {TAKE} THEN 'tfidf_routed' ELSE 'llm' END AS classifier_source FROM p")
def cls_arbitrate(spark, d):
    return models.arbitrate(two_predictions(spark, d), "p1", "c1", "p2", "c2").select("doc_id", "intent", "confidence", "classifier_source")


@query("cls_arbitration_stats", f"WITH {TWO_SQL} SELECT count(*) FILTER (c1 >= 0.5) AS primary_only, count(*) FILTER (c1 < 0.5) AS routed, count(*) FILTER (c1 < 0.5 AND p1 <> p2) AS disagreements FROM p")
def cls_arbitration_stats(spark, d):
    return models.arbitration_stats(models.arbitrate(two_predictions(spark, d), "p1", "c1", "p2", "c2"))


GOLD_WORDS = [("fr", 0.9, ["et", "les", "en"]), ("de", 0.9, ["die", "und"]), ("es", 0.9, ["los", "de"])]


def labelled_messages(spark, d):
    """Customer messages with a label from function words."""
    label, _ = lexicon.cascade(F.col("text"), GOLD_WORDS, ("en", 0.5))
    return message_table(spark, d).withColumn("label", label)


def trained(spark, d):
    return models.TextClassifier.train(labelled_messages(spark, d), "tweet_id", "text", "label", q.LANGS)


LABELLED = f"{q.T}, labelled AS (SELECT tweet_id, {q.case('text', GOLD_WORDS, 0, 'en')} AS label FROM tweets WHERE inbound)"


def prediction_facts(predicted, label, confidence, *by):
    """Rows per group, and how many have a known label and a probability that can be the highest of them."""
    valid = F.col(label).isin(*q.LANGS) & F.col(confidence).between(round(1 / len(q.LANGS), 4), 1)
    return predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), F.count_distinct(F.struct(*predicted.columns[:1])).alias("n_keys"))


@query("cls_logreg", f"""WITH {LABELLED}, texts AS (SELECT tweet_id, text FROM tweets WHERE inbound),
{counts_sql('c', 'texts', 'tweet_id', 'text', False)}, {vocab_sql('c', 'texts', '')}, {weights_sql('w', 'c', 'tweet_id')},
per AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1), held AS (SELECT label, sum(w) AS total FROM w JOIN labelled USING (tweet_id) GROUP BY 1)
SELECT label, n, n AS n_valid, n AS n_keys, round_even(1::DOUBLE / (SELECT count(*) FROM per), 4) AS mass,
round_even(coalesce(total, 0) / n / (SELECT count(*) FROM per), 3) AS term_mass, true AS at_optimum FROM per LEFT JOIN held USING (label)""")
def cls_logreg(spark, d):
    """CLS1: trained on the labelled messages and applied to them: no row is lost, and the fit is the optimum, where a
    label's probabilities and its terms' weigh what the labelled rows weigh, which the SQL sums up without a model."""
    data = labelled_messages(spark, d)
    model = trained(spark, d)
    predicted = model.predict(data, "tweet_id", "text").join(data.select("tweet_id", "label"), "tweet_id")
    best = model.optimality().select("label", F.round("mass", 4).alias("mass"), F.round("term_mass", 3).alias("term_mass"), (F.col("largest") < 1e-5).alias("at_optimum"))
    return prediction_facts(predicted, "intent", "confidence", "label").join(best, "label")


@query("cls_pseudo_label", "SELECT lang, count(*) AS n, count(*) AS n_valid, count(*) AS n_keys FROM documents GROUP BY 1")
def cls_pseudo_label(spark, d):
    """CLS6: the labelled messages train, a whole other corpus is labelled, without losing a row."""
    docs = table(spark, d, "documents")
    predicted = trained(spark, d).predict(docs, "doc_id", "text", "pseudo_intent", "pseudo_confidence").join(docs.select("doc_id", "lang"), "doc_id")
    return prediction_facts(predicted, "pseudo_intent", "pseudo_confidence", "lang")


@query("cls_crossval", f"""WITH {LABELLED}, f AS (SELECT label AS gold, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || tweet_id), tweet_id) - 1) % 5)::BIGINT AS fold FROM labelled)
SELECT gold, fold, count(*) AS n, count(*) AS n_valid, count(*) AS n_keys FROM f GROUP BY 1, 2""")
def cls_crossval(spark, d):
    """CLS5: out-of-fold predictions of the labelled messages, counted by label and fold."""
    out = models.cross_validated(labelled_messages(spark, d), "tweet_id", "text", "label")
    return prediction_facts(out, "predicted", "confidence", "gold", "fold").withColumn("fold", F.col("fold").cast("bigint"))


def embedding_rows(spark, d):
    return models.dense_features(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("clu_kmeans_sweep", "SELECT unnest([8, 9, 10, 11, 12])::BIGINT AS k, (SELECT count(*) FROM embeddings) AS n, unnest([8, 9, 10, 11, 12])::BIGINT AS n_clusters, true AS in_range, 0::BIGINT AS misplaced")
def clu_kmeans_sweep(spark, d):
    """CLU1, CLU2: sizes sum up to all rows, the silhouette is one and the kept centres cost no more than any start
    (in_range), and no row is nearer to another centre than its own."""
    rows = embedding_rows(spark, d)
    table_, fitted = models.kmeans_sweep(rows)
    facts = table_.select(
        F.col("k").cast("bigint").alias("k"), F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"),
        F.size("sizes").cast("bigint").alias("n_clusters"), F.col("silhouette").between(-1, 1).alias("in_range"), "costs",
    )
    misplaced = None
    for k, model in fitted.items():
        centres = [F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()]
        far = lambda c: F.aggregate(F.zip_with(models.vector_to_array("features"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        gaps = F.array(*[far(c) for c in centres])
        placed = model.transform(rows).select("prediction", gaps.alias("gaps"))
        wrong = placed.agg(F.count_if(F.get("gaps", F.col("prediction")) > F.array_min("gaps") + 1e-6).alias("misplaced"), F.sum(F.array_min("gaps")).alias("cost")).withColumn("k", F.lit(k).cast("bigint"))
        misplaced = wrong if misplaced is None else misplaced.unionByName(wrong)
    least = (F.size("costs") > 1) & (F.col("cost") <= F.array_min("costs") * (1 + 1e-6))
    return facts.join(misplaced, "k").select("k", "n", "n_clusters", (F.col("in_range") & least).alias("in_range"), "misplaced")


@query("clu_text_sweep", f"""WITH {counts_sql('c', 'documents', 'doc_id', 'text', True)}, {vocab_sql('c', 'documents')}, known AS (SELECT DISTINCT doc_id FROM c JOIN vocab USING (term))
SELECT unnest([4, 6])::BIGINT AS k, (SELECT count(*) FROM known) AS n, unnest([4, 6])::BIGINT AS n_clusters""")
def clu_text_sweep(spark, d):
    """CLU1 on TF-IDF rows: no document with a known term is lost, and every k has its clusters."""
    docs = table(spark, d, "documents")
    counts, vocab = features.fit(docs, "doc_id", "text", q.STOP)
    rows = features.vectors(counts, vocab, "doc_id", V.MAX_INDEX_TERMS)
    found, _ = models.kmeans_sweep(rows, ks=(4, 6), starts=2, size=V.MAX_INDEX_TERMS)
    return found.select(
        F.col("k").cast("bigint").alias("k"), F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"),
        F.size("sizes").cast("bigint").alias("n_clusters"),
    )


LABEL_MEANS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS centre FROM (
SELECT label, i, avg(x[i]) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(x) GROUP BY ALL) GROUP BY 1)"""


@query("clu_nearest", f"""WITH {LABEL_MEANS}, s AS (SELECT label AS cluster, vec_id, list_distance(x, centre) AS far FROM e JOIN c USING (label))
SELECT cluster::BIGINT AS cluster, row_number() OVER (PARTITION BY cluster ORDER BY round_even(far, 9), vec_id) AS rank, vec_id, round_even(far, 6) AS distance FROM s QUALIFY rank <= 15""")
def clu_nearest(spark, d):
    """CLU3, WIN4: given labels are the clusters, their means the centres."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    means = rows.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("m"))
    centres = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))
    assigned = rows.select("vec_id", "cluster", models.array_to_vector("x").alias("features"))
    out = models.nearest_assigned(assigned, centres, "vec_id")
    return out.select(F.col("cluster").cast("bigint"), F.col("rank").cast("bigint"), "vec_id", "distance")


@query("clu_silhouette", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label, vec_id % 3 AS third FROM embeddings),
a AS (SELECT 'label' AS assignment, vec_id, x, label::VARCHAR AS c FROM e UNION ALL SELECT 'third', vec_id, x, third::VARCHAR FROM e),
sizes AS (SELECT assignment, c, count(*) AS n FROM a GROUP BY ALL),
far AS MATERIALIZED (SELECT p.vec_id AS i, q.vec_id AS j, list_distance(p.x, q.x) AS d FROM e p, e q),
sums AS (SELECT o.assignment, o.vec_id, o.c AS own, t.c, sum(d) AS d FROM far JOIN a o ON o.vec_id = i JOIN a t ON t.vec_id = j AND t.assignment = o.assignment GROUP BY ALL),
means AS (SELECT assignment, vec_id, own, max(CASE WHEN s.c = own THEN d / greatest(n - 1, 1) END) AS mine, min(CASE WHEN s.c <> own THEN d / n END) AS other,
max(CASE WHEN s.c = own THEN n END) AS n FROM sums s JOIN sizes USING (assignment, c) GROUP BY ALL),
scores AS (SELECT assignment, own AS cluster, CASE WHEN n > 1 AND greatest(mine, other) > 0 THEN (other - mine) / greatest(mine, other) ELSE 0 END AS s FROM means)
SELECT assignment, cluster, count(*) AS n, round_even(avg(s), 6) AS silhouette FROM scores GROUP BY GROUPING SETS ((assignment), (assignment, cluster))""")
def clu_silhouette(spark, d):
    """CLU2: by plain distances, of the given labels and of thirds by id, together and per cluster."""
    rows = table(spark, d, "embeddings").withColumn("third", F.col("vec_id") % 3)
    return plain_silhouette(rows, "embedding", ["label", "third"]).withColumn("silhouette", F.round("silhouette", 6))
