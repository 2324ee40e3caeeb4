"""Queries of the operators here: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import language, licenses, merkle, packing, periodic, pieces, pii, ppm, quality_model, quality_rules, secrets, simhash, vptree
from threadloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_best_fit_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op7_simhash_near_dedup")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found.fp).alias("fingerprint"), "component_id")


@query("op6_secret_scans")
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def _quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_model.fit_and_classify(docs, read_table(spark, sf_dir, "labels"))


@query("op8_language_id")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs, limits=False))


@query("op9_lm_scoring")
def _ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def _quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


NEAREST_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM (SELECT DISTINCT * FROM u WHERE vec_id % 20 = 0) q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20"""


@query("op5_approximate_nearest_neighbours", NEAREST_SQL)
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read_table(spark, sf_dir, "embeddings"))


@query("op3_sentencepiece")
def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(read_table(spark, sf_dir, "documents"))


def _licenses_sql() -> str:
    """Exact containment of every template's distinct five-word shingles in whole documents."""
    shingles = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
    words = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
    given = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    return f"""WITH t AS (SELECT template, license, {shingles} AS ts FROM (SELECT template, license, {words.format('txt')} AS w FROM (VALUES {given}) AS g(template, license, txt))),
d AS MATERIALIZED (SELECT doc_id, {shingles} AS ds FROM (SELECT doc_id, {words.format('text')} AS w FROM documents) WHERE len(w) >= 5)
SELECT doc_id, license, template, max(len(list_intersect(ts, ds)) / len(ts)) AS containment FROM d, t WHERE len(ts) > 0 AND len(list_intersect(ts, ds)) / len(ts) >= {licenses.CONTAINMENT}::DOUBLE GROUP BY ALL"""


@query("op4_license_scans", _licenses_sql())
def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).select("doc_id", "license", "template", "containment")


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string, which DuckDB has no function for: eight shifts a character."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))"
    shifted = lambda a: f"CASE WHEN {a} & 1 = 1 THEN xor({a} >> 1, 3988292384) ELSE {a} >> 1 END"
    start = "CASE WHEN e >= 0 THEN xor(a, e) ELSE a END"
    return f"xor(4294967295::BIGINT, list_reduce({steps}, lambda a, e: {shifted(f'({start})')}, 4294967295::BIGINT))"


def _merkle_sql(source_levels: int = 5, top_levels: int = 4) -> str:
    """Enough levels for 16^5 rows a source and 16^4 sources; a tree that has come to one node stays as it is."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in [*fields, text])})"
    parts = [
        f"""b AS MATERIALIZED (SELECT *, {leaf('text')} AS leaf FROM documents)""",
        f"""a AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '-') AS tree, leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN
{leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE leaf END AS given,
row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM b)""",
        "s0 AS (SELECT tree, r, leaf AS d FROM a)",
    ]

    def level(prefix: str, k: int) -> list[str]:
        run = f"PARTITION BY tree, r // 16 ORDER BY r ROWS BETWEEN"
        return [
            f"""{prefix}x{k} AS MATERIALIZED (SELECT tree, r, d, count(*) OVER (PARTITION BY tree) AS n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le,
coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri FROM {prefix}{k})""",
            f"{prefix}{k + 1} AS MATERIALIZED (SELECT tree, r // 16 AS r, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY r)) END AS d FROM {prefix}x{k} GROUP BY tree, r // 16)",
        ]

    for k in range(source_levels):
        parts += level("s", k)
    parts.append(f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS r, d, tree AS name FROM s{source_levels})")
    for k in range(top_levels):
        parts += level("t", k)
    parts.append(
        "p0 AS (SELECT a.doc_id, a.leaf, a.given, a.tree, a.r, t0.r AS tr, t0.d AS subroot, (SELECT d FROM t{0}) AS root, '' AS proof, a.given AS f FROM a JOIN t0 ON a.tree = t0.name)".format(top_levels)
    )
    every = [("s", k, "p.tree = x.tree", "p.r") for k in range(source_levels)] + [("t", k, "TRUE", "p.tr") for k in range(top_levels)]
    for i, (prefix, k, tree, rank) in enumerate(every):
        parts.append(
            f"""p{i + 1} AS (SELECT p.* REPLACE (p.proof || CASE WHEN x.n = 1 THEN '' ELSE x.le || x.ri END AS proof, CASE WHEN x.n = 1 THEN p.f ELSE sha256(x.le || p.f || x.ri) END AS f)
FROM p{i} p JOIN {prefix}x{k} x ON {tree} AND x.r = {rank} // {16 ** k})"""
        )
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{len(every)}"""


@query("op13_merkle_manifest", _merkle_sql())
def _merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_ascii(F.col("text")))
    # A NULL text stays NULL, so its leaf is the original one, tampered with or not.
    proofs = merkle.verify(merkle.manifest(read_table(spark, sf_dir, "documents"), changed))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Pairs of equal words per distance, stretches of them by their place less their number, the smallest distance of each.
PERIODIC_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
k AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
l AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM k),
t AS MATERIALIZED (SELECT rid, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM l),
q AS MATERIALIZED (SELECT x.rid, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS stretch FROM q),
u AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY rid, q, stretch HAVING count(*) >= greatest(q, 12 - q)),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM u GROUP BY rid, start, length),
a AS (SELECT rid, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY rid),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
o AS (SELECT t.rid, t.i, t.w FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = t.rid AND t.i >= r.start + r.period AND t.i < r.start + r.length)),
c AS (SELECT rid, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM o GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM l LEFT JOIN a USING (rid) LEFT JOIN b USING (rid) LEFT JOIN c USING (rid)"""


@query("op11_periodic_runs", PERIODIC_SQL)
def _periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.scan(periodic.with_loops(read_table(spark, sf_dir, "documents")))
    best = periodic.longest_run(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        periodic.runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_pii")
def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"), pii.fit())
