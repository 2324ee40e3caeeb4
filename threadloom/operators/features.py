"""TF-IDF features as relations: vocabulary, weights, vectors."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import values as V
from threadloom.functions.text import drop_stop_words, ngrams, tokens
from threadloom.operators.ranks import order_hash, position_by_hash, position_by_range
from threadloom.sources.scratch import stage_table

# The counting functions travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK_CHARS = 16_000_000  # characters of text, or of the texts that a range of terms comes from, that a task takes
SPAN_TOKENS = 500_000  # tokens that are counted at a time
ENTRIES = "array<struct<term:string,tf:int>>"


def terms(text: Column, stop_words: Sequence[str] = (), bigrams: bool = True) -> Column:
    """TXT1-TXT3 in one expression."""
    toks = drop_stop_words(tokens(text), stop_words)
    return ngrams(toks) if bigrams else toks


def _spans(lengths: np.ndarray, most: int):
    """(first row, end) of runs of rows with about `most` elements each, one row at least."""
    lo, ends = 0, np.cumsum(lengths)
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _entries_of(lists: pa.Array, stop_words: Sequence[str], bigrams: bool) -> pa.Array:
    """Per list of tokens its distinct terms with their counts."""
    n = len(lists)
    flat = lists.flatten()
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    if stop_words:
        kept = pc.invert(pc.is_in(flat, value_set=pa.array(stop_words, flat.type)))
        flat, row = flat.filter(kept), row[kept.to_numpy(zero_copy_only=False)]
    if bigrams and len(flat) > 1:
        same = row[1:] == row[:-1]
        pairs = pc.binary_join_element_wise(flat[:-1].filter(pa.array(same)), flat[1:].filter(pa.array(same)), pa.scalar(" ", flat.type))
        flat, row = pa.concat_arrays([flat, pairs]), np.r_[row, row[1:][same]]
    coded = flat.dictionary_encode()
    distinct = max(1, len(coded.dictionary))
    pair, tf = np.unique(row * distinct + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    struct = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % distinct)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pair // distinct, np.arange(n + 1)).astype(np.int32)), struct)


def _counted(toks: Column, stop_words: Sequence[str], bigrams: bool) -> Column:
    @F.arrow_udf(ENTRIES)
    def count(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        parts = [_entries_of(lists.slice(lo, hi - lo), stop_words, bigrams) for lo, hi in _spans(lengths, SPAN_TOKENS)]
        return pa.concat_arrays(parts) if parts else _entries_of(lists, stop_words, bigrams)

    return count.asNondeterministic()(toks)  # else a filter on the result counts a second time


def _tasks(df: DataFrame, text: str) -> int:
    """Tasks for the texts, as many as a shuffle has at least; more texts are more tasks, not larger ones."""
    chars = df.agg(F.sum(F.char_length(text).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / TASK_CHARS))


def packed_counts(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = (), bigrams: bool = True, tasks: int | None = None) -> DataFrame:
    """One row per key that has a term: `entries`, its distinct terms with their counts.

    A text is counted where it is, so its terms cross no network and stand in no hash table of a whole task.  Keys that
    come more than once, and NULL, are looked for first; only their rows are put together by key and term.
    """
    tasks = tasks or _tasks(df, text)
    rows = df.select(key, text)
    count = lambda part: part.repartition(tasks, key).select(key, _counted(tokens(F.col(text)), list(stop_words), bigrams).alias("entries")).filter(F.size("entries") > 0)
    repeated = stage_table(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_key")), "repeated-keys")
    if repeated.isEmpty():
        return count(rows)
    same = F.col(key).eqNullSafe(F.col("_key"))
    often = count(rows.join(repeated, same, "left_semi")).select(key, F.inline("entries")).groupBy(key, "term").agg(F.sum("tf").cast("int").alias("tf"))
    return count(rows.join(repeated, same, "left_anti")).unionByName(often.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("entries")))


def counts_of(packed: DataFrame, key: str) -> DataFrame:
    """One row per (key, term) of packed counts."""
    return packed.select(key, F.inline("entries")).select(key, "term", F.col("tf").cast("long").alias("tf"))


def term_counts(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = (), bigrams: bool = True) -> DataFrame:
    """One row per (key, term) with its count."""
    return counts_of(packed_counts(df, key, text, stop_words, bigrams), key)


def vocabulary(counts: DataFrame, min_df: int = V.MIN_DOC_FREQ, max_terms: int | None = None) -> DataFrame:
    """TXT4: term, document frequency and corpus count; the most frequent `max_terms`, ties by term.

    Term totals are written once.  The number of terms per corpus count, a small frame,
    tells the count at which the limit falls; terms above it are in, and only among terms of that count does the order
    of terms decide, by their positions.  Nothing is sorted in one task.
    """
    vocab = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter(F.col("df") >= min_df)
    if not max_terms:
        return vocab
    vocab = stage_table(vocab, "terms")
    higher = W.partitionBy(F.lit(0)).orderBy(F.desc("cf")).rowsBetween(W.unboundedPreceding, -1)
    per_count = vocab.groupBy("cf").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    cut, above, n = per_count.filter(F.col("above") < max_terms).agg(F.min("cf"), F.max("above"), F.min_by("n", "cf")).first()
    if cut is None or above + n <= max_terms:
        return vocab if cut is None else vocab.filter(F.col("cf") >= cut)
    ties = position_by_range(vocab.filter(F.col("cf") == cut), [], ["term"]).filter(F.col("position") < max_terms - above)
    return vocab.filter(F.col("cf") > cut).unionByName(ties.select(*vocab.columns))


def with_idf(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """TXT5: smooth idf ln((1+n)/(1+df))+1."""
    return vocab.withColumn("idf", F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + F.lit(1.0))


BROADCAST_TERMS = 100_000


def _small(vocab: DataFrame, max_terms: int | None) -> DataFrame:
    # Only a vocabulary with a small fixed limit is broadcast; any other joins by shuffle, where adaptive
    # execution splits hot terms (its side has one row per term).
    return F.broadcast(vocab) if max_terms and max_terms <= BROADCAST_TERMS else vocab


def _weighed(packed: DataFrame, vocab_idf: DataFrame, key: str) -> DataFrame:
    """(key, e): per row of packed counts with a known term `e.row`, the terms' rows in the vocabulary, and `e.weight`, unit
    length.  The vocabulary is small, or bounded by a model on the driver, and travels with the tasks."""
    known = vocab_idf.select("term", "term_id", "idf").toPandas().sort_values("term_id")
    shared = packed.sparkSession.sparkContext.broadcast((pa.array(known["term"], pa.string()), known["term_id"].to_numpy(np.int32), known["idf"].to_numpy(np.float64)))

    @F.arrow_udf("struct<term_ids:array<int>,terms:array<string>,weights:array<double>>")
    def weigh(entries: pa.Array) -> pa.Array:
        names, ids, idf = shared.value
        flat = entries.flatten()
        row = np.repeat(np.arange(len(entries)), pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False))
        at = pc.fill_null(pc.index_in(flat.field("term"), value_set=names), -1).to_numpy(zero_copy_only=False)
        hit = at >= 0
        at, row, tf = at[hit], row[hit], flat.field("tf").to_numpy(zero_copy_only=False)[hit]
        order = np.lexsort((at, row))
        at, row, tf = at[order], row[order], tf[order]
        raw = (1.0 + np.log(tf)) * idf[at]
        norm = np.sqrt(np.bincount(row, raw**2, minlength=len(entries)))
        begin = pa.array(np.searchsorted(row, np.arange(len(entries) + 1)).astype(np.int32))
        columns = [pa.array(ids[at]), names.take(pa.array(at)), pa.array(raw / norm[row])]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(begin, c) for c in columns], names=["term_ids", "terms", "weights"])

    return packed.select(key, weigh.asNondeterministic()("entries").alias("e")).filter(F.size("e.term_ids") > 0)


def _is_small(counts: DataFrame, max_terms: int | None) -> bool:
    return "entries" in counts.columns and bool(max_terms) and max_terms <= BROADCAST_TERMS


def weights(counts: DataFrame, vocab_idf: DataFrame, key: str, max_terms: int | None = None) -> DataFrame:
    """TXT5, TXT6: (key, term, weight) with sublinear tf, idf and unit length per key; counts are packed or a row per term.

    Terms outside the vocabulary fall out, so this also transforms unseen texts.
    """
    if _is_small(counts, max_terms):
        return _weighed(counts, vocab_idf, key).select(key, F.inline(F.arrays_zip(F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))))
    counts = counts_of(counts, key) if "entries" in counts.columns else counts
    raw = counts.join(_small(vocab_idf, max_terms), "term").withColumn("raw", (F.lit(1.0) + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return raw.withColumn("weight", F.col("raw") / norm).select(key, "term", "weight")


def vectors(counts: DataFrame, vocab_ids: DataFrame, key: str, max_terms: int | None = None) -> DataFrame:
    """(key, term_ids, weights) sorted by term id, unit length; keys without a known term are absent."""
    if _is_small(counts, max_terms):
        return _weighed(counts, vocab_ids, key).select(key, "e.term_ids", "e.weights")
    counts = counts_of(counts, key) if "entries" in counts.columns else counts
    raw = counts.join(_small(vocab_ids.select("term", "term_id", "idf"), max_terms), "term").select(
        key, "term_id", ((F.lit(1.0) + F.log("tf")) * F.col("idf")).alias("raw")
    )
    packed = raw.groupBy(key).agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.array_sort(F.collect_list(F.struct("term_id", "raw"))).alias("v")
    )
    return packed.select(
        key, F.transform("v", lambda x: x["term_id"]).alias("term_ids"), F.transform("v", lambda x: x["raw"] / F.col("norm")).alias("weights")
    )


def numbered(vocab: DataFrame, max_terms: int | None) -> DataFrame:
    """Dense term ids from 0: one window over a size-limited list, else positions in hash order."""
    if max_terms:
        position = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("term"))
        return vocab.withColumn("term_id", (position - 1).cast("int"))
    placed = position_by_hash(vocab.withColumn("_h", order_hash("term", F.col("term"))), [], "_h", "term", "_pos")
    return placed.withColumn("term_id", (F.col("_pos") - 1).cast("int")).drop("_h", "_pos")


def fit(
    df: DataFrame, key: str, text: str, stop_words: Sequence[str] = (), bigrams: bool = True,
    min_df: int = V.MIN_DOC_FREQ, max_terms: int | None = V.MAX_INDEX_TERMS,
) -> tuple[DataFrame, DataFrame]:
    """Packed term counts of a corpus and its vocabulary with idf and ids."""
    tasks = _tasks(df, text)
    counts = packed_counts(df, key, text, stop_words, bigrams, tasks)
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    placed = counts_of(counts, key).select("term", "tf").repartition(tasks, "term")  # totals of a term in one of as many tasks as the texts take
    return counts, with_idf(numbered(vocabulary(placed, min_df, max_terms), max_terms), n_docs)


def ml_vectors(vecs: DataFrame, keep: Sequence[str], size: int, name: str) -> DataFrame:
    """Vectors as an MLlib sparse column `features`, staged as a table.

    The file holds the vector type's own struct, so no row passes through Python, and the iterations of a fit
    read the table instead of tokenising again.
    """
    from pyspark.ml.linalg import VectorUDT

    packed = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("term_ids").alias("indices"), F.col("weights").alias("values")
    )
    flat = vecs.select(*keep, packed.alias("features"))
    schema = T.StructType([vecs.schema[c] for c in keep] + [T.StructField("features", VectorUDT())])
    return stage_table(flat, name, schema)

