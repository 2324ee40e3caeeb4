"""Quality rules with adaptive thresholds.

The counts of a text are column expressions; nothing leaves the JVM.  What is usual for a rate is learnt from the
corpus: every (lang, source) has a mergeable quantile sketch per rate, sketches of a language are merged, and those of
all languages, and a group with too few documents of its own uses the next wider one.  A document is kept if no rate
lies beyond the fences of its group, joined back by lang and source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import stage_table

# fixed values: the base rules
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per hundred words

SKETCH_K = 800  # rank error well below 1 %
LEAST_DOCS = 200  # documents of a group from which its own sketch is used
FENCE = 3.0  # spreads (quartile to median) beyond the quartile
TAIL = 0.99  # of a group's documents are inside its upper fence, and as many inside a lower one


@dataclass(frozen=True)
class Rate:
    """A rate of a text and the least distance above the upper quartile (below the lower one, where low values are
    odd too) that may be held against it; far less than the base allows."""

    name: str
    value: Column
    slack: float
    low_slack: float | None = None


def rates() -> list[Rate]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rate("symbol_rate", F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), 0.03),
        Rate("dup_line_rate", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.05),
        Rate("repeat_rate", F.col("n_repeat_words") / n, 0.03),
        Rate("capital_rate", F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)), 0.20),
        Rate("word_length", F.col("word_chars") / n, 4.0, 2.0),
    ]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _places(ordered: Column) -> Column:
    """Places of windows found twice or more, from (hash, place) in order, where equal windows stand side by side.
    `ordered` must be a column of the frame: inside the lambdas it is looked up, not worked out again."""
    same = lambda a, b: F.coalesce(F.get(ordered, a)["h"] == F.get(ordered, b)["h"], F.lit(False))
    found = F.transform(ordered, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"]))
    return F.sort_array(F.filter(found, lambda x: x.isNotNull()))


def _covered(places: Column) -> Column:
    """Words in windows of 5 that begin at these places: 5 each, fewer where the next one begins sooner."""
    gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text; each step is a projection over the rows."""
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("words", words_of(F.col("text")))
    hashed = split.withColumn(
        "hashes",
        F.when(
            F.size("words") >= WINDOW_WORDS,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - WINDOW_WORDS),
                lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW_WORDS)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    measured = hashed.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[A-Z]+", ""))).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    placed = measured.select(
        *[c for c in measured.columns if c not in ("lines", "ordered")],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _places(F.col("ordered")).alias("places"),
    )
    repeated = F.when(F.col("places").isNull(), 0).otherwise(_covered(F.col("places")))
    return placed.withColumn("n_repeat_words", repeated.cast("long")).drop("places")


def _limit(sketch: str, slack: float, fence: float, sign: int) -> Column:
    """Upper (sign 1) or lower (-1) fence: the quartile and `fence` times its distance from the median, but at least
    the slack away from it and no nearer than the TAIL quantile."""
    at = lambda q: F.kll_sketch_get_quantile_double(sketch, F.lit(q if sign > 0 else 1 - q))
    quartile, spread = at(0.75), sign * (at(0.75) - at(0.5))
    return quartile + sign * F.greatest(fence * spread, sign * (at(TAIL) - quartile), F.lit(slack))


def fences(rated: DataFrame, judged: Sequence[Rate], least_docs: int = LEAST_DOCS, fence: float = FENCE) -> DataFrame:
    """Fences of every rate per (lang, source), from sketches of its own, its language's or all documents; see `_limit`."""
    names = [r.name for r in judged]
    own = rated.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in names])
    own = stage_table(own, "sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(c).alias(c) for c in names]]
    suffixed = lambda df, s: df.select(*[c for c in ("lang",) if c in df.columns], F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in names])
    by_lang = suffixed(own.groupBy("lang").agg(*merged), "lang").withColumnRenamed("lang", "of_lang")
    joined = own.join(by_lang, own.lang.eqNullSafe(by_lang.of_lang)).drop("of_lang")

    ends = [(f"most_{r.name}", r.name, r.slack, 1) for r in judged]
    ends += [(f"least_{r.name}", r.name, r.low_slack, -1) for r in judged if r.low_slack is not None]
    overall = own.agg(*merged).select(*[F.when(F.col("n") > 0, _limit(c, slack, fence, sign)).alias(end) for end, c, slack, sign in ends]).first()  # one number per fence
    out = []
    for end, c, slack, sign in ends:
        own_fence, lang_fence, all_fence = _limit(c, slack, fence, sign), _limit(f"{c}_lang", slack, fence, sign), F.lit(overall[end])
        out.append(F.when(F.col("n") >= least_docs, own_fence).when(F.col("n_lang") >= least_docs, lang_fence).otherwise(all_fence).alias(end))
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *out)


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS, fence: float = FENCE) -> DataFrame:
    """doc_id, the counts, base_failed, every rate with its fence, and kept, for every row.

    Takes doc_id, text, lang and source; other columns are not read.  A NULL text is empty and fails the base; NULL
    lang or source are groups of their own.  Documents that fail the base take part in no sketch.  An empty table
    gives no rows.
    """
    all_rates = rates()
    base = counts(docs).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )
    rated = stage_table(base.select("*", *[r.value.alias(r.name) for r in all_rates]), "rates")
    limits = fences(rated.filter("not base_failed"), all_rates, least_docs, fence)
    limits = stage_table(limits, "fences")
    same_group = rated.lang.eqNullSafe(limits.f_lang) & rated.source.eqNullSafe(limits.f_source)
    within = F.lit(True)
    for r in all_rates:
        within = within & (F.col(r.name) <= F.coalesce(F.col(f"most_{r.name}"), F.lit(float("inf"))))
        if r.low_slack is not None:
            within = within & (F.col(r.name) >= F.coalesce(F.col(f"least_{r.name}"), F.lit(float("-inf"))))
    return rated.join(limits, same_group, "left").drop("f_lang", "f_source").withColumn("kept", ~F.col("base_failed") & within)
