"""Scalar expressions on scores, risks, requests and responses."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import values as V
from threadloom.functions.lexicon import mentions
from threadloom.functions.text import named


def rounded(c: Column, digits: int) -> Column:
    """PRJ30: round to `digits` (at most 7) from the exact binary value, ties to even.

    `round` works on the shortest decimal form and rounds ties up, so 0.155 (which is stored a little below) and
    0.125 would come out differently.  The product with the power of ten is carried with its rounding error
    (the factor is split so that both partial products are exact), and the error decides near ties.
    """
    scale = float(10**digits)

    def exact(x: Column) -> Column:
        product = x * F.lit(scale)
        spread = x * F.lit(134217729.0)
        high = spread - (spread - x)
        error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
        whole = F.floor(product)
        over = (product - whole - F.lit(0.5)) + error
        up = (over > 0) | ((over == 0) & (F.pmod(whole, F.lit(2)) == 1))
        return F.when(F.isnan(x) | (F.abs(x) >= 1e8), x).otherwise((whole + F.when(up, 1).otherwise(0)) / F.lit(scale))

    return named(c.cast("double"), exact)


def two_places(c: Column) -> Column:
    """Text of a number with two decimals, rounded as `rounded` does."""
    return F.format_string("%.2f", rounded(c, 2))


def pointer_ids(c: Column) -> Column:
    """PRJ11: '5, 7.0,x' to [5, 7]; blanks and ids that are not numbers are skipped."""
    parts = F.transform(F.split(c, ","), lambda x: F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint")))
    return F.array_compact(parts)


def parse_created_at(c: Column) -> Column:
    """PRJ9: 'Tue Oct 31 22:10:47 +0000 2017' to a UTC timestamp; anything else to NULL."""
    return F.try_to_timestamp(F.substring(c, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))


def minutes_between(start: Column, end: Column) -> Column:
    """PRJ10: minutes from start to end as a double; works for both timestamp types."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6.0e7)


def clamp_score(c: Column, default: int = 3) -> Column:
    """PRJ14: whole score held inside 1..5; missing or unreadable becomes the default."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c.try_cast("double").try_cast("int"), F.lit(default))))


def minutes_risk(
    minutes: Column, floor: float = V.RISK_FLOOR_MINUTES, ceiling: float = V.RISK_CEILING_MINUTES
) -> Column:
    """PRJ15: position of the minutes between floor and ceiling, held inside 0..1, 4 dp."""
    span = (minutes - F.lit(floor)) / F.lit(ceiling - floor)
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), span)), 4)


def urgency_risk(text: Column, severity: Column, urgency_words: Sequence[str] = tuple(V.URGENCY_WORDS)) -> Column:
    """PRJ16: severity score plus a bonus for an urgency word, at most 1; empty text is routine."""
    base = F
    for name, score in V.SEVERITY_RISK.items():
        base = base.when(severity == name, F.lit(score))
    base = base.otherwise(F.lit(V.UNKNOWN_SEVERITY_RISK))
    score = F.when(mentions(text, urgency_words), F.least(F.lit(1.0), base + F.lit(V.URGENCY_BONUS))).otherwise(base)
    blank = text.isNull() | (text == "")
    return rounded(F.when(blank, F.lit(V.SEVERITY_RISK["routine"])).otherwise(score), 4)


def composite_risk(intent_risk: Column, sentiment_risk: Column) -> Column:
    """PRJ17: equal-weight mean of both risks, held inside 0..1, 4 dp."""
    both = F.lit(0.5) * intent_risk + F.lit(0.5) * sentiment_risk
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both)), 4)


def invalid_confidence(c: Column) -> Column:
    """PRJ22: NULL, NaN, below 0 or above 1 (NaN is tested first: it compares as the largest value)."""
    return F.coalesce(F.isnan(c) | (c < 0) | (c > 1), F.lit(True))


def usable_confidence(c: Column) -> Column:
    return F.when(invalid_confidence(c), F.lit(0.0)).otherwise(c)


def known_label(label: Column, confidence: Column, labels: Sequence[str], other: str = V.OTHER_INTENT) -> tuple[Column, Column]:
    """PRJ23: a label outside the set becomes `other` at confidence 0.50."""
    ok = F.coalesce(label.isin(*labels), F.lit(False))
    return F.when(ok, label).otherwise(F.lit(other)), rounded(F.when(ok, confidence).otherwise(F.lit(0.5)), 4)


def yes(c: Column) -> Column:
    """PRJ21: 'yes' in any case with blanks around is true, all else false."""
    return F.coalesce(F.lower(F.trim(c)) == "yes", F.lit(False))


def request_key(model: Column, temperature: Column, system: Column, prompt: Column) -> Column:
    """PRJ18: sha-256 of the request's parts; a NULL system prompt counts as empty."""
    return F.sha2(F.concat_ws(":::", model, temperature, F.coalesce(system, F.lit("")), prompt), 256)


def render_request(head: Column | str, items: Column, item: str, tail: Column | str) -> Column:
    """PRJ19: head, one numbered line per evidence item (`item` is a printf format of number and text), tail."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    lines = F.transform(items, lambda x, i: F.format_string(item, i + 1, x))
    return F.concat(as_col(head), F.array_join(lines, ""), as_col(tail))


def parse_response(c: Column, schema: T.StructType | str, required: Sequence[str]) -> tuple[Column, Column]:
    """PRJ20: strip code fences, parse JSON; returns the struct and whether all required fields were there."""
    body = F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?|```$", ""))
    parsed = F.from_json(body, schema)
    ok = F.lit(True)
    for f in required:
        ok = ok & F.get_json_object(body, f"$.{f}").isNotNull()
    return parsed, F.coalesce(ok, F.lit(False))


def choose_reply(escalated: Column, banner: Column, evidence_reply: Column, fallback: str = V.FALLBACK_REPLY) -> Column:
    """PRJ24: banner when escalated, else the evidence reply, else the fallback text."""
    return F.when(escalated, banner).otherwise(F.coalesce(evidence_reply, F.lit(fallback)))


def citations(hits: Column) -> tuple[Column, Column, Column]:
    """PRJ26: cited ids, cited replies and the best similarity (0 without hits)."""
    return (
        F.transform(hits, lambda h: h["brand_tweet_id"]),
        F.transform(hits, lambda h: h["brand_reply_text"]),
        F.coalesce(F.try_element_at(hits, F.lit(1))["similarity"], F.lit(0.0)),
    )


def reply_features(reply: Column) -> dict[str, Column]:
    """PRJ28: boolean traits of a reply text."""
    low = F.lower(F.coalesce(reply, F.lit("")))

    def shows(phrases: Sequence[str]) -> Column:
        found = F.lit(False)
        for x in phrases:
            found = found | low.contains(x)
        return found

    traits = {name: shows(phrases) for name, phrases in V.REPLY_TRAITS.items()}
    return {"escalated": low.contains(V.ESCALATED_MARK), **traits, "is_short": F.char_length(low) < 120}


def low_score(scores: Sequence[Column], below: int = 5) -> Column:
    """FLT14: is any score below the bound; missing scores count as full marks."""
    return F.exists(F.array(*[F.coalesce(s, F.lit(5)) for s in scores]), lambda x: x < below)


FRACTION_STEPS = 200  # of the continued fraction; it settles in far fewer where it is used


def _log_gamma(x: Column) -> Column:
    """Stirling's series behind eight steps of the recurrence; x > 0."""
    y = x + F.lit(8.0)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shifted = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    for i in range(8):
        shifted = shifted - F.log(x + F.lit(float(i)))
    return shifted


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by products of its convergents' ratios."""
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def step(s: Column, m: Column) -> Column:
        c, d, h = s["c"], s["d"], s["h"]
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        first = F.struct((1 + even / c).alias("c"), (1 / (1 + even * d)).alias("d"), h.alias("h"))
        mid = F.transform(F.array(first), lambda s: state(s["c"], s["d"], s["h"] * s["c"] * s["d"]))
        last = F.transform(mid, lambda s: F.struct((1 + odd / s["c"]).alias("c"), (1 / (1 + odd * s["d"])).alias("d"), s["h"].alias("h")))
        return F.get(F.transform(last, lambda s: state(s["c"], s["d"], s["h"] * s["c"] * s["d"])), 0)

    d = 1 / (1 - (a + b) * x / (a + 1))
    steps = F.transform(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), lambda m: m.cast("double"))
    return F.aggregate(steps, state(F.lit(1.0), d, d), step)["h"]


def regularized_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function; 0 < x < 1, a and b positive."""
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    return F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x) / b)


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a value at least as far from 0 as t, with df degrees of freedom; NULL for df < 1 or a NULL t."""
    n = df.cast("double")
    x = n / (n + t * t)
    return F.when(t.isNull() | (df < 1), None).when(t == 0, 1.0).when(x <= 0, 0.0).otherwise(F.least(F.lit(1.0), regularized_beta(n / 2, F.lit(0.5), x)))
