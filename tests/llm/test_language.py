import random
import zlib

import numpy as np
from pyspark.sql import functions as F
import pytest

from llm_cases import EDGES, frame
from threadloom.llm import language

WORDS = {"aa": "the and with from this that have which".split(), "bb": "der und mit von nicht für straße über".split()}


def texts(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(5, 40))), lang) for i in range(n) for lang in [rnd.choice("ab") * 2]]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language.Network.fresh(["a", "b", "c"], 5, rng)
    text, target = rng.integers(97, 103, (7, 4)).astype(np.uint8), rng.integers(0, 3, 7)
    _, grads = net.gradients(text, target)
    for p, d in zip(net.parameters(), grads):
        for _ in range(4):
            at = tuple(int(rng.integers(97, 103)) if k == 0 and s == 256 else int(rng.integers(0, s)) for k, s in enumerate(p.shape))
            old, step = p[at], 1e-2
            p[at] = old + step
            up = net.gradients(text, target)[0]
            p[at] = old - step
            down = net.gradients(text, target)[0]
            p[at] = old
            assert (up - down) / (2 * step) == pytest.approx(float(d[at]), abs=3e-4)


def test_word_values_are_the_sums_over_its_bytes():
    net = language.Network.fresh(["a", "b"], 4, np.random.default_rng(1))
    words = [b"ab", b"x" * 60, b"abc", b"ab"]
    got = net.words(words)
    assert got[:, 2].tolist() == [2, 60, 3, 2] and np.allclose(got[:, :2].sum(axis=1), got[:, 2], atol=1e-4)
    assert np.allclose(got[0], got[3]) and np.allclose(got[0, :2], net.label(np.frombuffer(b"ab", np.uint8)[None])[0].sum(axis=0))


def test_held_out_accuracy_and_inputs(spark, edges):
    rows = texts(400, 1)
    docs = frame(spark, rows)
    net = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, net).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in got if got[i]["held_out"]] and sorted(i for i in got if got[i]["held_out"]) == sorted(held)
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # neither lang nor doc_id is an input of a prediction
    other = {r["doc_id"]: r["lang_pred"] for r in language.predict(frame(spark, [(i + 5000, t, None) for i, t, _ in rows]), net).collect()}
    assert all(other[i + 5000] == got[i]["lang_pred"] for i in got)
    by = {(r["doc_id"], r["lang_pred"] == "und") for r in language.predict(edges, net).collect()}
    assert {(1, True), (2, True), (3, True), (9, True), (4, False), (8, False), (None, False)} <= by
    kept = language.keep_known(edges, net)
    assert kept.columns == edges.columns and not {1, 2, 3, 9} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn_from(spark, edges, nothing):
    net = language.fit(nothing)
    assert {r["lang_pred"] for r in language.predict(edges, net).collect()} == {"und"}
    assert language.predict(edges, net).count() == len(EDGES) and language.predict(nothing, net).count() == 0


def test_keeping_with_one_language_and_with_none(spark):
    rows = [(i, f"the text number {i} of one language", "en") for i in range(30)] + [(100, "12 34", "en"), (101, None, "en")]
    for lang in ("en", None):
        docs = frame(spark, [(i, t, lang) for i, t, _ in rows])
        kept = {r["doc_id"] for r in language.keep_known(docs, language.fit(docs)).collect()}
        assert kept == set(range(30)), lang


def test_unlearnt_language_is_not_kept(spark):
    rows = texts(900, 3)
    net = language.fit(frame(spark, rows), docs_per_lang=100)
    assert set(net.limits) == {"aa", "bb"} and all(0.6 < x <= 1 for x in net.limits.values())
    rnd = random.Random(4)
    known = [(i + 5000, t, None) for i, t, _ in texts(300, 5)]
    other = [(i + 9000, " ".join(rnd.choices("kuka joka olen hyvä tämä sinä mutta koska ей это как".split(), k=30)), None) for i in range(100)]
    kept = [r["doc_id"] for r in language.keep_known(frame(spark, known + other), net).collect()]
    assert sum(i < 9000 for i in kept) >= 290 and sum(i >= 9000 for i in kept) <= 5


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """A repeated id brings no more rows than others."""
    seen = []
    monkeypatch.setattr(language, "train", lambda words, targets, languages: seen.append(len(words)) or language.Network.fresh(languages, 4, np.random.default_rng(0)))
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert zlib.crc32(b"7") % 3 != 1
    language.fit(rows, docs_per_lang=50, words_per_doc=4, limits=False)
    assert 0 < seen[0] <= 200


def test_limits_from_one_pass_keep_the_same_rows(spark):
    rows = texts(600, 7)
    net = language.fit(frame(spark, rows), docs_per_lang=80)
    docs = frame(spark, [*rows, (7001, "12", "aa"), (7002, None, "bb"), (None, "x", None)])
    want = sorted(r["doc_id"] for r in language.keep_known(docs, net).filter("doc_id is not null").collect())
    net.limits = {}
    kept = language.keep_known(docs, net)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == want
