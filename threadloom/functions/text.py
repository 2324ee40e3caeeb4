"""Text expressions: normal form, redaction, anonymising, tokens and n-grams.

All are JVM expressions on columns.  `redact` works frame to frame, because each redaction step reads
the text the step before it produced and also counts matches on it: separate projections let the
optimiser keep one evaluation per step instead of nesting the same regex again and again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import values as V

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = r"[\p{L}\p{N}_]"


def named(c: Column, use: Callable[[Column], Column]) -> Column:
    """Bind an expression to a name: `use` may mention it many times and it is still evaluated once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _only_where(c: Column, guard: Callable[[Column], Column], pattern: str) -> Column:
    """Delete a pattern; texts that fail the cheap guard skip the regex."""
    return named(c, lambda t: F.when(guard(t), F.regexp_replace(t, pattern, "")).otherwise(t))


def normal_form(c: Column) -> Column:
    """PRJ1: lower-case, drop URLs, handles and ASCII punctuation, collapse blanks; NULL gives ''."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = _only_where(t, lambda x: x.contains("http") | x.contains("www."), r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+")
    t = _only_where(t, lambda x: x.contains("@"), f"@{WORD}+")
    t = F.translate(t, ASCII_PUNCTUATION, "")
    # Single plain blanks are left alone; only what has to change is matched.
    return F.trim(F.regexp_replace(t, r"[\s\p{Z}&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+", " "))


def text_length(c: Column) -> Column:
    """PRJ8: length in characters."""
    return F.char_length(c)


def text_key(c: Column) -> Column:
    """Fixed-width stand-in for a text as a shuffle key: whole texts need not travel to be compared."""
    return F.sha2(c, 256)


def _step(df: DataFrame, text: str, hits: str, pattern: str, replacement: str, guard: Column) -> DataFrame:
    # The guard is a cheap necessary condition, so most rows never enter the regex engine.
    df = df.withColumn(hits, F.when(guard, F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0)))
    return df.withColumn(
        text, F.when(F.col(hits) > 0, F.regexp_replace(text, pattern, replacement)).otherwise(F.col(text))
    )


def redact(
    df: DataFrame,
    text: str,
    out: str = "redacted_text",
    count: str = "pii_count",
    types: str = "pii_types",
    steps: Sequence[str] = ("email", "phone", "digits", "device"),
    keep_device_id: bool = False,
) -> DataFrame:
    """PRJ2-PRJ6: redact e-mails, phones, long digit runs and device ids, in that order.

    Adds the redacted text, the number of hits (each counted on the text left by the step before) and the
    ordered list of types.  The device step removes the identifier; `keep_device_id=True` leaves the
    identifier in front of the tag instead.
    """
    has_digit = lambda name: F.col(name).rlike(r"\p{Nd}")
    device_to = f"$1 {V.DEVICE_TAG}" if keep_device_id else V.DEVICE_TAG
    # (?U): word boundaries, digits and blanks in the Unicode sense, on every Java version.
    plan = {
        "email": (V.EMAIL_PATTERN, V.EMAIL_TAG, lambda n: F.contains(F.col(n), F.lit("@"))),
        "phone": ("(?U)" + V.PHONE_PATTERN, V.PHONE_TAG, has_digit),
        "digits": ("(?U)" + V.LONG_DIGITS_PATTERN, V.LONG_DIGITS_TAG, has_digit),
        "device": ("(?iU)" + V.DEVICE_PATTERN, device_to, lambda n: F.col(n).rlike("(?i)imei|serial|sn")),
    }
    names = dict(zip(plan, V.PII_TYPES, strict=True))
    df = df.withColumn(out, F.col(text))
    counters = {}
    for step in plan:
        if step not in steps:
            continue
        counters[step] = f"_hits_{step}"
        pattern, tag, guard = plan[step]
        df = _step(df, out, counters[step], pattern, tag, guard(out))
    total = sum((F.coalesce(F.col(h), F.lit(0)) for h in counters.values()), F.lit(0))
    found = F.array_compact(F.array(*[F.when(F.col(h) > 0, F.lit(names[s])) for s, h in counters.items()]))
    return df.withColumn(count, total).withColumn(types, found).drop(*counters.values())


def anonymize(df: DataFrame, text: str, out: str = "anonymized_text") -> DataFrame:
    """PRJ7: redact, then mask handles and URLs and trim; blank or NULL gives ''."""
    df = redact(df, text, out, "_anon_count", "_anon_types").drop("_anon_count", "_anon_types")
    t = F.regexp_replace(F.coalesce(F.col(out), F.lit("")), "@[A-Za-z0-9_]+", "@[USER]")
    t = F.regexp_replace(t, r"https?://[^\s\p{Z}]+", "[URL]")
    return df.withColumn(out, F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def tokens(c: Column) -> Column:
    """TXT1: lower-case word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD + "{2,}"), F.lit(0))


def drop_stop_words(toks: Column, stop_words: Sequence[str]) -> Column:
    """TXT2: remove stop words before n-grams are formed, so bigrams bridge them."""
    if not stop_words:
        return toks
    return F.filter(toks, lambda t: ~t.isin(*stop_words))


def ngrams(toks: Column) -> Column:
    """TXT3: unigrams followed by bigrams."""
    pairs = F.zip_with(toks, F.slice(toks, F.lit(2), F.size(toks)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.concat(toks, F.array_compact(pairs))
