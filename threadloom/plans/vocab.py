"""Word lists from the test tables' own vocabulary, and SQL fragments the DuckDB checks share.

The tables hold invented prose, so the default lexicons would not match anything in them.
"""

from __future__ import annotations

from threadloom.sources.adapters import TWEETS_SQL

INSULTS = ["worthless", "pathetic"]
GRUMBLES = ["rest", "heat", "stupid"]
FOLLOWUP = ["that", "les", "die", "los"]
PRAISE = ["thing", "inst", "zu", "les"]
URGENT = ["heat", "der", "por", "this"]
STOP = ["the", "of", "and", "in", "to", "is", "de", "la", "die", "der"]
RULES = [
    ("rule:abuse", [r"\b(?:stupid|idiot)\b", r"\b(?:worthless|pathetic)\b"]),
    ("rule:legal_threat", [r"\b(?:licen(?:se|sed)|terms of use)\b", r"\b(?:all rights)\b"]),
    ("rule:security", [r"\b(?:token|api key)\b", r"\b(?:password (?:was )?stolen)\b"]),
]
TOPICS = {
    "heat": ["heat", "heit"],
    "thing": ["thing", "inst"],
    "les": ["les ", "des "],
    "und": ["und ", "der "],
    "que": ["que ", "los "],
}
LANGS = ["en", "fr", "de", "es"]
LANG_WORDS = [
    ("en", 0.95, ["the", "of"]),
    ("fr", 0.60, ["le", "les"]),
    ("de", 0.45, ["der", "und"]),
    ("es", 0.30, ["el", "que"]),
]
LANG_DEFAULT = ("en", 0.72)
LANG_MEDIANS = {"en": 101.7, "fr": 41.58, "de": 64.48, "es": 38.15}


def has(col: str, words, match: str = "word") -> str:
    body = "|".join(w.replace("-", "\\-") for w in words)
    pattern = f"(^|[^\\p{{L}}\\p{{N}}_])(?:{body})($|[^\\p{{L}}\\p{{N}}_])" if match == "word" else f"(?:{body})"
    return f"coalesce(regexp_matches({col}, '(?i){pattern}'), false)"


def topics(col: str) -> str:
    return " + ".join(f"({has(f'lower({col})', w, 'substring')})::INT" for w in TOPICS.values())


def case(col: str, table, what: int, default) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return "CASE " + " ".join(f"WHEN {has(col, r[2])} THEN {show(r[what])}" for r in table) + f" ELSE {show(default)} END"


def severity(col: str) -> str:
    return f"CASE WHEN {has(col, INSULTS)} THEN 'severe' WHEN {has(col, GRUMBLES)} THEN 'frustrated' ELSE 'routine' END"


def rule_code(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN '{c}'" for c, ps in RULES for p in ps) + " END"


def rule_snippet(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN regexp_extract({col}, '(?i){p}')" for c, ps in RULES for p in ps) + " END"


PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def normal(col: str) -> str:
    t = f"regexp_replace(regexp_replace(lower(coalesce({col}, '')), 'https?://[^\\s\\p{{Z}}]+|www\\.[^\\s\\p{{Z}}]+', '', 'g'), '@[\\p{{L}}\\p{{N}}_]+', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '[[:punct:]]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


IDS = "list_filter(list_transform(str_split({0}, ','), lambda x: coalesce(try_cast(trim(x) AS BIGINT), try_cast(try_cast(trim(x) AS DOUBLE) AS BIGINT))), lambda x: x IS NOT NULL)"
PARENT = "coalesce(try_cast(trim(in_response_to_tweet_id) AS BIGINT), try_cast(try_cast(trim(in_response_to_tweet_id) AS DOUBLE) AS BIGINT))"

T = f"tweets AS MATERIALIZED ({TWEETS_SQL})"
PTR = f"""ptr AS (SELECT tweet_id, inbound, generate_subscripts(ids, 1) - 1 AS position, unnest(ids) AS target_id
  FROM (SELECT tweet_id, inbound, {IDS.format('response_tweet_id')} AS ids FROM tweets WHERE response_tweet_id IS NOT NULL))"""
PAIRS = f"""{T}, {PTR},
fwd AS (SELECT DISTINCT p.tweet_id AS c, b.tweet_id AS b, b.author_id AS a FROM ptr p JOIN tweets b ON p.target_id = b.tweet_id WHERE p.inbound AND NOT b.inbound),
rev AS (SELECT DISTINCT c.tweet_id AS c, t.tweet_id AS b, t.author_id AS a FROM (SELECT *, {PARENT} AS parent FROM tweets) t JOIN tweets c ON t.parent = c.tweet_id WHERE NOT t.inbound AND c.inbound),
tagged AS (SELECT coalesce(f.c, r.c) AS c, coalesce(f.b, r.b) AS b, coalesce(f.a, r.a) AS a,
  CASE WHEN f.c IS NOT NULL AND r.c IS NOT NULL THEN 'both' WHEN f.c IS NOT NULL THEN 'forward_only' ELSE 'reverse_only' END AS join_source
  FROM fwd f FULL JOIN rev r ON f.c = r.c AND f.b = r.b),
pairs AS MATERIALIZED (SELECT c.tweet_id AS customer_tweet_id, c.author_id AS customer_author_id, c.text AS customer_text, c.created_at AS customer_created_at,
  b.tweet_id AS brand_tweet_id, t.a AS brand_author_id, b.text AS brand_reply_text, b.created_at AS brand_reply_created_at, join_source
  FROM tagged t JOIN tweets c ON t.c = c.tweet_id JOIN tweets b ON t.b = b.tweet_id)"""
STAMP = "strptime({0}, '%a %b %d %H:%M:%S +0000 %Y')"
FOLLOWED = f"""{PAIRS},
kids AS (SELECT parent, count(*) AS n, max(CASE WHEN rn = 1 THEN text END) AS first_text FROM (
  SELECT {PARENT} AS parent, text, row_number() OVER (PARTITION BY {PARENT} ORDER BY {STAMP.format('created_at')}, tweet_id) AS rn
  FROM tweets WHERE inbound AND in_response_to_tweet_id IS NOT NULL) GROUP BY parent),
followed AS MATERIALIZED (SELECT p.*, coalesce(n, 0) > 0 AS has_followup, first_text AS followup_text, coalesce(n, 0) AS followup_count, 1 + coalesce(n, 0) AS thread_length
  FROM pairs p LEFT JOIN kids ON kids.parent = p.brand_tweet_id)"""
THREADS = f"""{FOLLOWED},
threads AS MATERIALIZED (SELECT customer_tweet_id, customer_text, customer_created_at, brand_tweet_id, brand_reply_text, brand_reply_created_at, has_followup, followup_text, thread_length,
  (epoch_us({STAMP.format('brand_reply_created_at')}) - epoch_us({STAMP.format('customer_created_at')})) / 6.0e7::DOUBLE AS response_time_minutes FROM followed)"""
FRUSTRATED = has("followup_text", FOLLOWUP)
USABLE = f"trim(brand_reply_text) <> '' AND NOT (has_followup AND {FRUSTRATED})"
CRITERIA = ["correctness", "groundedness", "completeness", "brand_voice", "tone"]
