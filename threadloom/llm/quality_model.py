"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text.

The model reads words as bytes, each with an end mark, in contexts of up to four bytes that begin at the word, so a
word's probability does not depend on where it stands and is computed once per distinct word and block.

Fitting: all trusted labelled rows but the held-out third (or `trusted_rows` of them) are counted by Spark, each task
adding up its own n-grams first; per order, n-gram counts are dealt out by context, discounts come from counts of counts,
and joins on the shortened n-gram add the lower order's probability.  The tables hold the distinct n-grams inside words,
which grow far slower than the text (README), and are sent to the tasks, where every block's distinct n-grams
are joined with them order by order.  All trusted rows that the model was not fitted on give the per-language quantile
of perplexity above which a document is rejected, from mergeable sketches.  Labels serve for nothing else; all
documents are scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import WordValues, raw_texts, remainder, spans_of
from threadloom.sources.scratch import stage_table

ORDER = 5
HELD_OUT_PART = 3  # one trusted row in so many is left out of the fit and gives thresholds
QUANTILE = 0.995  # of held-out trusted documents of a language
SLACK = 1.02  # times that quantile
QUANTILE_ACCURACY = 10_000  # rank error of the mergeable quantiles: one in so many
PRIOR_SYMBOLS = 60  # symbols at the mean rate that every document is credited with, so that short ones vary less
LEAST_ROWS = 40  # trusted rows outside the fit from which a language has its own threshold
SYMBOLS = 256
START, END = 32, 32
COUNTED_BYTES = 4_000_000  # of text whose distinct words are cut into n-grams at a time
HELD_GRAMS = 2_000_000  # distinct n-grams that a task adds up before it hands them on


def word_grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all words, one for each byte and the end mark, and the word's number of each.

    An n-gram's lowest byte is the symbol, its other bytes the context; in front of a word stand a start mark and
    zero bytes."""
    head = b"\0" * (order - 2) + bytes([START])
    text = np.frombuffer(b"".join([head + w + bytes([END]) for w in words]), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    packed = np.zeros(len(text), np.int64)
    for back in range(order):
        packed[back:] |= text[: len(text) - back] << (8 * back)
    starts = np.cumsum(sizes + order - 1) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return packed[starts[owner] + within], owner


@dataclass
class Grams:
    """Per order k (1 to ORDER): sorted n-grams with log10 probability, sorted contexts with log10 weight of the
    lower order."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    def score(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's symbol."""
        distinct, at = np.unique(packed, return_inverse=True)
        out, open_ = np.zeros(len(distinct)), np.arange(len(distinct))
        for k in range(len(self.grams), 0, -1):
            keys = distinct[open_] & ((1 << 8 * k) - 1)
            hit, row = _find(self.grams[k - 1], keys)
            out[open_[hit]] += self.logs[k - 1][row[hit]]
            open_, keys = open_[~hit], keys[~hit]
            known, row = _find(self.contexts[k - 1], keys >> 8)
            out[open_[known]] += self.weights[k - 1][row[known]]
        out[open_] -= np.log10(SYMBOLS)
        return out[at]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Rows (log10 probability, symbols) per word."""
        packed, owner = word_grams(words, len(self.grams))
        return np.stack([np.bincount(owner, self.score(packed), len(words)), np.bincount(owner, minlength=len(words))], axis=1)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    row = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[row] == keys, row


def _count_grams(order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "c"])
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = raw_texts(batch)
            for lo, hi in spans_of(texts, COUNTED_BYTES):
                words = Counter(w for t in texts[lo:hi] for w in (t or b"").split())
                if not words:
                    continue
                packed, owner = word_grams(list(words), order)
                n = np.fromiter(words.values(), np.int64, len(words))
                grams, at = np.unique(np.concatenate([grams, packed]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n[owner]])).astype(np.int64)
                if len(grams) > HELD_GRAMS:
                    yield rows()
                    grams, counts = grams[:0], counts[:0]
        if len(grams):
            yield rows()

    return run


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    row = counts.agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def fit_grams(trusted: DataFrame, order: int = ORDER) -> Grams:
    """The model of the texts of `trusted`; its tables hold their distinct n-grams."""
    counts = trusted.select("text").mapInArrow(_count_grams(order), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    levels = [stage_table(counts, "grams")]
    for k in range(order - 1, 0, -1):  # lower orders count distinct continuations
        shorter = levels[-1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram"))
        levels.append(stage_table(shorter.groupBy("gram").agg(F.count(F.lit(1)).alias("c")), "grams"))
    fitted, lower = Grams([], [], [], []), None
    for k, level in enumerate(reversed(levels), start=1):
        d = _discounts(level)
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        of_context = W.partitionBy("context")  # at most 256 symbols each
        shares = level.withColumn("context", F.shiftright("gram", 8)).select(
            "gram",
            "context",
            ((F.col("c") - taken) / F.sum("c").over(of_context)).alias("own"),
            (F.sum(taken).over(of_context) / F.sum("c").over(of_context)).alias("weight"),
        )
        if lower is None:
            joined = shares.withColumn("p", F.col("own") + F.col("weight") / SYMBOLS)
        else:
            short = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            joined = shares.withColumn("short", short).join(lower, "short").withColumn("p", F.col("own") + F.col("weight") * F.col("lower_p"))
        level_p = stage_table(joined.select("gram", "context", "p", "weight"), "gram-probabilities")
        lower = level_p.select(F.col("gram").alias("short"), F.col("p").alias("lower_p"))
        rows = level_p.toPandas().sort_values("gram")  # distinct n-grams, which the model sends to the tasks
        contexts = rows.drop_duplicates("context").sort_values("context")
        fitted.grams.append(rows["gram"].to_numpy())
        fitted.logs.append(np.log10(rows["p"].to_numpy()))
        fitted.contexts.append(contexts["context"].to_numpy())
        fitted.weights.append(np.log10(contexts["weight"].to_numpy()))
    return fitted


def document_sums(model: Grams, texts: list[bytes | None], values: WordValues) -> np.ndarray:
    """Rows (log10 probability, symbols) per text."""
    parts = [values.sums([(t or b"").split() for t in texts[lo:hi]]) for lo, hi in spans_of(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 2))


@dataclass
class QualityModel:
    grams: Grams
    mean: float  # -log10 probability per symbol of trusted text
    limits: dict[str | None, float]  # by language; None: of all

    def rates(self, sums: np.ndarray) -> np.ndarray:
        return (self.mean * PRIOR_SYMBOLS - sums[:, 0]) / (PRIOR_SYMBOLS + sums[:, 1])


def _trusted(docs: DataFrame, labels: DataFrame, trusted_rows: int | None) -> tuple[Grams, DataFrame]:
    """N-grams of the fitted documents, and the ids of all other trusted ones."""
    trusted = stage_table(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted-ids")
    fitted = trusted if trusted_rows is None else trusted.orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(trusted_rows)
    fitted = stage_table(fitted.filter(remainder(F.col("doc_id"), HELD_OUT_PART) != 0), "fitted-ids")
    texts = docs.select("doc_id", "text").join(fitted, "doc_id", "left_semi")
    one = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")  # of a repeated id one row
    texts = texts.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth")
    return fit_grams(texts), trusted.join(fitted, "doc_id", "left_anti")


def _with_limits(grams: Grams, sums: DataFrame, others: DataFrame, quantile: float, slack: float) -> QualityModel:
    """The model with limits from the sums (doc_id, lang, log, symbols) of the trusted documents outside the fit."""
    sums = stage_table(sums.join(others, "doc_id", "left_semi").select("lang", "log", "symbols"), "trusted-sums")
    total = sums.agg(F.sum("log"), F.sum("symbols")).first()
    mean = float(-(total[0] or 0.0) / max(1.0, total[1] or 0.0))
    model = QualityModel(grams, mean, {})
    limit = (F.percentile_approx(_rate(mean), quantile, QUANTILE_ACCURACY) * slack).alias("limit")
    of_all = sums.agg(limit).first()[0]
    model.limits[None] = float("inf") if of_all is None else of_all
    for row in sums.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), limit).collect():  # a row per language
        if row["n"] >= LEAST_ROWS:
            model.limits[row["lang"]] = row["limit"]
    return model


def _rate(mean: float) -> Column:
    return (F.lit(mean * PRIOR_SYMBOLS) - F.col("log")) / (F.lit(PRIOR_SYMBOLS) + F.col("symbols"))


def _limit_of(model: QualityModel, lang: Column) -> Column:
    out = F.lit(float(model.limits[None]))
    for name, limit in model.limits.items():
        if name is not None:
            out = F.when(lang == name, F.lit(float(limit))).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None, quantile: float = QUANTILE, slack: float = SLACK) -> QualityModel:
    """A model of all documents with quality 1 (one row per id) but the held-out third, thresholds from that third; with
    `trusted_rows` the third is taken from so many of lowest hash, the others are all held out too.

    Texts are counted whole.  Limits
    are kept by the values of lang with LEAST_ROWS trusted documents or more; others are held to the limit over all.
    NULL ids are not trusted, a NULL text counts as empty; without trusted rows nothing is rejected but texts without a word.
    """
    grams, others = _trusted(docs, labels, trusted_rows)
    return _with_limits(grams, _sums(docs, grams).filter("doc_id is not null"), others, quantile, slack)


def fit_and_classify(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """`classify` by the model that `fit` gives, each document scored once: limits and verdicts come from the same sums."""
    grams, others = _trusted(docs, labels, trusted_rows)
    sums = stage_table(_sums(docs, grams), "document-sums")
    model = _with_limits(grams, sums.filter("doc_id is not null"), others, quantile, slack)
    rate, limit = _rate(model.mean), _limit_of(model, F.col("lang"))
    return sums.select(
        "doc_id", F.col("symbols").cast("long").alias("n_symbols"), F.pow(F.lit(10.0), rate).alias("perplexity"), F.pow(F.lit(10.0), limit).alias("limit"),
        ((rate <= limit) & (F.col("symbols") > 0)).alias("kept"),
    )


SUMMED = ("_quality_log", "_quality_symbols")  # added to staged rows, and taken off again


def fit_and_keep(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """The rows of `docs`, with all columns, that `fit_and_classify` keeps; rows are scored once and written with their sums."""
    grams, others = _trusted(docs, labels, trusted_rows)
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.DoubleType()) for c in SUMMED)])
    shared, text = docs.sparkSession.sparkContext.broadcast(grams), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = WordValues(shared.value.words, 2)
        for batch in batches:
            sums = document_sums(shared.value, batch.column(text).cast(pa.binary()).to_pylist(), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=[*batch.schema.names, *SUMMED])

    rows = stage_table(docs.mapInArrow(run, schema), "quality-sums")
    sums = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col(SUMMED[0]).alias("log"), F.col(SUMMED[1]).alias("symbols"))
    model = _with_limits(grams, sums.filter("doc_id is not null"), others, quantile, slack)
    rate = (F.lit(model.mean * PRIOR_SYMBOLS) - F.col(SUMMED[0])) / (F.lit(PRIOR_SYMBOLS) + F.col(SUMMED[1]))
    return rows.filter((rate <= _limit_of(model, F.col("lang"))) & (F.col(SUMMED[1]) > 0)).drop(*SUMMED)


def _sums(docs: DataFrame, grams: Grams) -> DataFrame:
    """doc_id, lang, log10 probability and symbols of every document; texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = WordValues(shared.value.words, 2)
        for batch in batches:
            sums = document_sums(shared.value, raw_texts(batch), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["doc_id", "lang", "log", "symbols"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, log double, symbols double")


def _classify(shared, text: int, lang: int, only_kept: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: QualityModel = shared.value
        values = WordValues(model.grams.words, 2)
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            sums = document_sums(model.grams, texts, values)
            rates = model.rates(sums)
            limits = np.array([model.limits.get(x, model.limits[None]) for x in batch.column(lang).to_pylist()])
            kept = (rates <= limits) & (sums[:, 1] > 0)
            if only_kept:
                yield batch.filter(pa.array(kept))
            else:
                columns = [batch.column(0), pa.array(sums[:, 1].astype(np.int64)), pa.array(10.0**rates), pa.array(10.0**limits), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_symbols", "perplexity", "limit", "kept"])

    return run


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, symbols scored, perplexity per symbol (shrunk to the trusted mean), its limit, and kept.

    Takes doc_id, text and lang; other columns are not read.  Texts that are NULL or have no word are not kept.  A NULL
    or unknown lang is held to the limit over all languages.  Every row gives one row, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "lang").mapInArrow(
        _classify(shared, 1, 2, False), "doc_id long, n_symbols long, perplexity double, limit double, kept boolean"
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of `docs` that `classify` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_classify(shared, docs.columns.index("text"), docs.columns.index("lang"), True), docs.schema)
