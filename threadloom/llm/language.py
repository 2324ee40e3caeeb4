"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a word (long ones in windows) forwards and backwards, labels every byte with a probability per
language, and a document's probabilities are the mean over its bytes.  It is trained in numpy by backpropagation
through time on words of a bounded sample of labelled documents (`docs_per_lang`, `words_per_doc`, `train_words`); a
word's labels do not depend on where it stands, so they are computed once per distinct word and block, and every
word of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import WordValues, raw_texts, remainder, spans_of
from threadloom.sources.scratch import stage_table

HIDDEN = 16
WINDOW = 24  # bytes read in one go
DOCS_PER_LANG = 150
WORDS_PER_DOC = 200
TRAIN_WORDS = 240_000  # over all languages
STEPS = 500
BATCH = 1024
RATE = 0.01
HELD_OUT_OF = 3
UNKNOWN = "und"
LEAST_QUANTILE = 0.005  # of the scores of a language's labelled documents, what a document must reach to be kept
LEAST_DOCS = 200  # labelled documents outside the sample from which a language has its own quantile
QUANTILE_ACCURACY = 10_000  # rank error of the mergeable quantiles: one in so many


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Direction:
    """Gates z (keep), r (reset) and candidate n, side by side: input rows per byte, recurrent weights, a bias of the
    recurrent part of n."""

    inputs: np.ndarray  # 256 x 3H
    recurrent: np.ndarray  # H x 3H
    bias: np.ndarray  # H

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.bias]

    def run(self, text: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [words, bytes, H] of words of one length; with `keep`, what backpropagation needs is appended."""
        h = np.zeros((len(text), len(self.recurrent)), np.float32)
        size = h.shape[1]
        states = np.empty((*text.shape, size), np.float32)
        for t in range(text.shape[1]):
            x = self.inputs[text[:, t]]
            u = h @ self.recurrent
            gates = _sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            un = u[:, 2 * size :] + self.bias
            n = np.tanh(x[:, 2 * size :] + r * un)
            if keep is not None:
                keep.append((h, z, r, un, n))
            h = n + z * (h - n)
            states[:, t] = h
        return states

    def backward(self, text: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of `parameters` by backpropagation through time."""
        size = len(self.recurrent)
        d_inputs, d_recurrent, d_bias = (np.zeros_like(p) for p in self.parameters())
        dh = np.zeros((len(text), size), np.float32)
        for t in reversed(range(text.shape[1])):
            h, z, r, un, n = kept[t]
            dh = dh + d_states[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dun = dn * r
            d_bias += dun.sum(axis=0)
            du = np.concatenate([dz, dr, dun], axis=1)
            d_recurrent += h.T @ du
            np.add.at(d_inputs, text[:, t], np.concatenate([dz, dr, dn], axis=1))
            dh = dh * z + du @ self.recurrent.T
        return [d_inputs, d_recurrent, d_bias]


@dataclass
class Network:
    languages: list[str]
    forwards: Direction
    backwards: Direction
    out: np.ndarray  # 2H x languages
    out_bias: np.ndarray
    limits: dict[str, float] = field(default_factory=dict)  # least score by language
    sample: list[int] = field(default_factory=list)  # ids of the documents it was fitted on

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        make = lambda: Direction(draw(256, 3 * hidden, scale=0.3), draw(hidden, 3 * hidden, scale=hidden**-0.5), np.zeros(hidden, np.float32))
        return cls(languages, make(), make(), draw(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.forwards.parameters(), *self.backwards.parameters(), self.out, self.out_bias]

    def label(self, text: np.ndarray) -> np.ndarray:
        """Probabilities [words, bytes, languages] for words of one length."""
        states = np.concatenate([self.forwards.run(text), self.backwards.run(text[:, ::-1])[:, ::-1]], axis=2)
        return _softmax(states @ self.out + self.out_bias)

    def gradients(self, text: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy per byte, every byte labelled with its word's language, and gradients of `parameters`."""
        kept_f, kept_b = [], []
        states = np.concatenate([self.forwards.run(text, kept_f), self.backwards.run(text[:, ::-1], kept_b)[:, ::-1]], axis=2)
        p = _softmax(states @ self.out + self.out_bias)
        rows = np.arange(len(text))
        loss = float(-np.log(np.maximum(p[rows, :, target], 1e-9)).mean())
        p[rows, :, target] -= 1
        d = p / text.size
        d_states = d @ self.out.T
        size = self.out.shape[0] // 2
        return loss, [
            *self.forwards.backward(text, kept_f, d_states[:, :, :size]),
            *self.backwards.backward(text[:, ::-1], kept_b, d_states[:, ::-1, size:]),
            np.tensordot(states, d, axes=((0, 1), (0, 1))),
            d.sum(axis=(0, 1)),
        ]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Per word: sums of its bytes' probabilities, and the number of bytes."""
        out = np.zeros((len(words), len(self.languages) + 1))
        for owner, text in by_length(words) if self.languages else ():
            p = self.label(text)
            np.add.at(out, owner, np.concatenate([p.sum(axis=1), np.full((len(text), 1), text.shape[1])], axis=1))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def by_length(words: list[bytes], window: int = WINDOW, rows: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, bytes) of pieces of one length each; words longer than `window` give several pieces."""
    pieces: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, w in enumerate(words):
        for at in range(0, len(w), window):
            piece = w[at : at + window]
            numbers, texts = pieces.setdefault(len(piece), ([], []))
            numbers.append(i)
            texts.append(piece)
    for size, (numbers, texts) in sorted(pieces.items()):
        for at in range(0, len(numbers), rows):
            part = np.frombuffer(b"".join(texts[at : at + rows]), np.uint8).reshape(-1, size)
            yield np.array(numbers[at : at + rows]), part


def train(words: list[bytes], targets: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network:
    """A network fitted with Adam; batches hold words of one length, languages weigh alike."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, hidden, rng)
    groups = [(targets[owner], text) for owner, text in by_length(words, rows=1 << 30)]
    if len(languages) < 2 or not groups:
        return net
    per_lang = [[np.flatnonzero(t == k) for k in range(len(languages))] for t, _ in groups]
    mass = np.array([text.size for _, text in groups], float)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        g = rng.choice(len(groups), p=mass / mass.sum())
        target, text = groups[g]
        share = max(1, BATCH // len(languages))
        rows = np.concatenate([rng.choice(r, share) for r in per_lang[g] if len(r)])
        _, grads = net.gradients(text[rows], target[rows])
        norm = np.sqrt(sum(float((x * x).sum()) for x in grads))
        scale = min(1.0, 5.0 / (norm + 1e-12))
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, d, m, v in zip(net.parameters(), grads, first, second):
            d *= scale
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _draw_words(per_doc: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out_l, out_w = batch.column(1).to_pylist(), [], []
            for lang, text in zip(langs, raw_texts(batch)):
                words = text.lower().split()
                words = words[:: max(1, -(-len(words) // per_doc))]  # evenly over the whole text
                out_w += words
                out_l += [lang] * len(words)
            yield pa.RecordBatch.from_arrays([pa.array(out_l, pa.string()), pa.array(out_w, pa.binary())], names=["lang", "word"])

    return run


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC, train_words: int = TRAIN_WORDS, limits: bool = True) -> Network:
    """A network from text and lang of documents that are not held out: per language at most `docs_per_lang` rows (those
    of lowest hash of id and text), of each at most `words_per_doc` words, in all about `train_words`.

    Rows with a NULL id, text or lang teach nothing; without any row to learn from the network knows no language.  Rows
    of a repeated id are rows like others.  The driver holds the sampled words: docs_per_lang rows a language, so that
    it and the output layer grow with the number of distinct values of lang, which is taken to be that of languages.
    `limits` also scores all labelled documents for the limits of `keep_known`, see `score_limits`.
    """
    learn = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null").filter(remainder(F.col("doc_id"), HELD_OUT_OF) != 1)
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text")
    sample = stage_table(learn.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= docs_per_lang).drop("nth"), "sample")
    per_doc = max(1, min(words_per_doc, train_words // max(1, sample.count())))
    rows = sample.select("text", "lang").mapInArrow(_draw_words(per_doc), "lang string, word binary").toPandas()  # bounded by the parameters above
    rows = rows.sort_values(["lang", "word"], kind="stable")
    languages = sorted(rows["lang"].unique())
    targets = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    net = train(list(rows["word"]), targets, languages)
    net.sample = sorted({r[0] for r in sample.select("doc_id").collect()})  # ids of the sampled rows
    if limits and len(languages) >= 2:
        shared = learn.sparkSession.sparkContext.broadcast(net)
        held = learn.select("lang", F.lit(False).alias("held_out"), "text", "doc_id")
        scored = held.mapInArrow(_predict(shared, ("lang", "doc_id")), "lang string, doc_id long, lang_pred string, score double")
        net.limits = score_limits(scored, net)
    return net


def score_limits(scored: DataFrame, net: Network, quantile: float = LEAST_QUANTILE, least_docs: int = LEAST_DOCS) -> dict[str, float]:
    """Per language, the low quantile of the scores of all its labelled documents (doc_id, lang, lang_pred, score) that
    are told to be of it.

    The network was fitted on the sample, so its documents do not count where `least_docs` others do; a language with
    fewer takes all of its own, and the quantile over all languages if that is lower.
    """
    ids = F.broadcast(scored.sparkSession.createDataFrame([(i,) for i in net.sample], "sample_id long"))
    right = scored.filter("lang = lang_pred").join(ids, F.col("doc_id") == F.col("sample_id"), "left")
    low = lambda c: F.percentile_approx(c, quantile, QUANTILE_ACCURACY)
    other = F.when(F.col("sample_id").isNull(), F.col("score"))
    found = right.rollup("lang").agg(F.count(other).alias("n"), low(other).alias("other"), low(F.col("score")).alias("every")).collect()  # a row per language
    of_all = next((r["every"] for r in found if r["lang"] is None), 0.0)
    return {r["lang"]: r["other"] if r["n"] >= least_docs else min(r["every"], of_all) for r in found if r["lang"] is not None}


def _has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _predict(shared, keep: tuple[str, str] = ("doc_id", "held_out")):
    """Adds lang_pred and score to the two columns named."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        width = len(net.languages) + 1
        values = WordValues(net.words, width, limit=max(1_000, min(400_000, 4_000_000 // width)))
        for batch in batches:
            texts = raw_texts(batch)
            parts = [np.zeros((0, width))]
            for lo, hi in spans_of(texts):
                parts.append(values.sums([(t or b"").lower().split() for t in texts[lo:hi]]))
            sums = np.concatenate(parts)
            pooled = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
            known = np.array([bool(net.languages) and t is not None and _has_letter(t) for t in texts], bool)
            best = pooled.argmax(axis=1) if net.languages else np.zeros(len(texts), np.int64)
            names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            score = np.where(known, np.minimum(pooled.max(axis=1, initial=0.0), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score, the mean probability of that language over all bytes of words.

    Reads only text to predict; doc_id says who was held out (a NULL id: not).  NULL texts and texts without a letter
    are `und` with score 0, as is all if nothing could be learnt.  Every row gives one row, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), HELD_OUT_OF) == 1).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(shared, column: int):
    predict_all = _predict(shared)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            text = batch.column(column)
            if len(net.languages) < 2:  # nothing to tell apart
                yield batch.filter(pa.array([t is not None and _has_letter(t) for t in text.cast(pa.binary()).to_pylist()], pa.bool_()))
                continue
            nothing = pa.nulls(batch.num_rows, pa.int64())
            found = next(predict_all([pa.RecordBatch.from_arrays([nothing, nothing, text], names=["doc_id", "held_out", "text"])]))
            names = found.column(2).to_pylist()
            known = np.array([x != UNKNOWN for x in names], bool)
            least = np.array([net.limits.get(x, 0.0) for x in names])
            yield batch.filter(pa.array(known & (found.column(3).to_numpy() >= least)))

    return run


def _with_scores(shared, column: int):
    predict_all = _predict(shared)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nothing = pa.nulls(batch.num_rows, pa.int64())
            found = next(predict_all([pa.RecordBatch.from_arrays([nothing, nothing, batch.column(column)], names=["doc_id", "held_out", "text"])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, found.column(2), found.column(3)], names=[*batch.schema.names, *SCORED])

    return run


SCORED = ("_language_pred", "_language_score")  # added to staged rows, and taken off again


def keep_known(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of `docs`, with all columns, whose language is known: a letter, and a score that reaches the limit of
    the language.  With fewer than two learnt languages, all rows with a letter.

    A network without limits takes them from `docs` itself: every row is scored once and written with its score, and
    limits and verdicts are read from that.  NULL and empty texts go; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    column = docs.columns.index("text")
    if net.limits or len(net.languages) < 2:
        return docs.mapInArrow(_keep(shared, column), docs.schema)
    schema = T.StructType([*docs.schema, T.StructField(SCORED[0], T.StringType()), T.StructField(SCORED[1], T.DoubleType())])
    scored = stage_table(docs.mapInArrow(_with_scores(shared, column), schema), "language-scores")
    learnt = scored.filter(remainder(F.col("doc_id"), HELD_OUT_OF) != 1).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col(SCORED[0]).alias("lang_pred"), F.col(SCORED[1]).alias("score"))
    least = F.lit(0.0)
    for name, limit in score_limits(learnt, net).items():
        least = F.when(F.col(SCORED[0]) == name, F.lit(limit)).otherwise(least)
    return scored.filter((F.col(SCORED[0]) != UNKNOWN) & (F.col(SCORED[1]) >= least)).drop(*SCORED)
