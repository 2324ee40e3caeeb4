"""Lexicon matching: word lists, ordered rule tables and keyword cascades as column expressions.

A lexicon is data (a list of words or patterns).  It compiles into one `rlike`, or into one CASE that
stops at the first hit, so it stays inside the scan stage whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import WORD


def _quote(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def _first_letters(words: Sequence[str]) -> str:
    """A lookahead for the first characters in both cases: it lets most positions fail on one table lookup."""
    first = {v for w in words for v in (w[0], w[0].lower(), w[0].upper())}
    first |= {"\u017f" for c in first if c in "sS"} | {"\u212a" for c in first if c in "kK"}  # fold to s and k
    return "(?=[" + "".join(re.sub(r"([\\^\]\[&-])", r"\\\1", c) for c in sorted(first)) + "])"


def word_pattern(words: Sequence[str], match: str = "word") -> str:
    """A case-insensitive alternation; `match` is 'word' (word-bounded) or 'substring'.

    The boundary is spelled out, because what `\\b` means for accented letters depends on the Java version.
    """
    body = "(?iU:" + "|".join(_quote(w) for w in words) + ")"
    if match == "word":
        body = f"(?<!{WORD}){body}(?!{WORD})"
    return _first_letters(words) + body


def mentions(c: Column, words: Sequence[str], match: str = "word") -> Column:
    """FLT2, FLT3, FLT5: does the text hold any of the words; NULL text is no match."""
    return F.coalesce(c.rlike(word_pattern(words, match)), F.lit(False))


def topics_hit(c: Column, topics: Mapping[str, Sequence[str]], match: str = "substring") -> Column:
    """PRJ12: number of topics with at least one of their words in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((F.when(mentions(low, words, match), 1).otherwise(0) for words in topics.values()), F.lit(0))


def multi_issue(c: Column, topics: Mapping[str, Sequence[str]], min_chars: int = 180, min_topics: int = 2) -> Column:
    """FLT7: long text that touches several topics."""
    return (F.char_length(c) >= min_chars) & (topics_hit(c, topics) >= min_topics)


def sarcasm_risk(c: Column, praise: Sequence[str], frustration: Sequence[str]) -> Column:
    """FLT9: praise and frustration in the same text."""
    return mentions(c, praise) & mentions(c, frustration)


def first_rule(c: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> tuple[Column, Column]:
    """FLT4: code and matched snippet of the first rule pattern that fires, both NULL when none does.

    The snippet column has its own ordered CASE: it is evaluated only where it is asked for.
    """
    code, snippet = F, F
    for name, patterns in rules:
        for p in patterns:
            hit = c.rlike("(?iU)" + p)
            code = code.when(hit, F.lit(name))
            snippet = snippet.when(hit, F.regexp_extract(c, "(?iU)" + p, 0))
    return code.otherwise(F.lit(None).cast("string")), snippet.otherwise(F.lit(None).cast("string"))


def cascade(
    c: Column, table: Sequence[tuple[str, float, Sequence[str]]], default: tuple[str, float], match: str = "word"
) -> tuple[Column, Column]:
    """CLS2: label and confidence of the first keyword group found in the text."""
    label, conf = F, F
    for name, score, words in table:
        hit = mentions(c, words, match)
        label = label.when(hit, F.lit(name))
        conf = conf.when(hit, F.lit(float(score)))
    return label.otherwise(F.lit(default[0])), conf.otherwise(F.lit(float(default[1])))


def severity(c: Column, severe: Sequence[str], frustrated: Sequence[str], match: str = "word") -> Column:
    """CLS3: severe, frustrated or routine, judged on the message alone."""
    return (
        F.when(mentions(c, severe, match), "severe").when(mentions(c, frustrated, match), "frustrated").otherwise("routine")
    )
