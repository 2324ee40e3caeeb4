"""Kneser-Ney and PPM against plain versions of their definitions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import EDGES, frame
from threadloom.llm import ppm, quality_model

START = b"\0\0\0 "


def symbols(word):
    context = START
    for b in word + b" ":
        yield context[-4:] + bytes([b])
        context += bytes([b])


def plain_kneser_ney(words):
    counts = {5: Counter(g for w in words for g in symbols(w))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        if not n[0] or not n[1]:
            return [0.5] * 3
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    found = {k: discounts(c) for k, c in counts.items()}

    def p(gram, k=5):
        if k == 0:
            return 1 / 256
        gram = gram[-k:]
        of = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not of:
            return p(gram, k - 1)
        taken = {g: found[k][min(c, 3) - 1] for g, c in of.items()}
        own = (of[gram] - taken[gram]) if gram in of else 0
        return (own + sum(taken.values()) * p(gram, k - 1)) / sum(of.values())

    return p


def test_kneser_ney_against_its_definition(spark):
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choices("abcé", k=rnd.randint(1, 6))) for _ in range(30)) for _ in range(12)]
    model = quality_model.fit_grams(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]))
    p = plain_kneser_ney([w for t in texts for w in t.encode().split()])
    for word in [b"a", b"abca", b"zz", b"abcz", "éé".encode(), b"abcabcabc"]:
        got = model.words([word])[0]
        assert got[0] == pytest.approx(sum(math.log10(p(g)) for g in symbols(word)), rel=1e-9) and got[1] == len(word) + 1
    context = int.from_bytes(b"abca", "big") << 8
    assert (10 ** model.score(context + np.arange(256))).sum() == pytest.approx(1)


def test_quality_keeps_clean_texts_and_drops_junk(spark, edges, nothing):
    rnd = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("the", "an", "er", "re") for b in ("tion", "ing", "ed", "es") for c in ("", "ly", "or")]
    clean = [(i, " ".join(rnd.choices(words, k=rnd.randint(20, 80))), "en") for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rnd.choices("QXZ#%$*", k=6)) for _ in range(40)), "en") for i in range(40)]
    docs = frame(spark, clean + junk)
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0, 0) for i, _, _ in clean[:200] + junk[:20]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in quality_model.classify(docs, model).collect()}
    assert sum(got[i] for i, _, _ in clean) >= 297 and not any(got[i] for i, _, _ in junk)
    kept = quality_model.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]}
    of_edges = quality_model.classify(edges, model).collect()
    assert len(of_edges) == len(EDGES) and not any(r["kept"] for r in of_edges if r["doc_id"] in (1, 2, 3))
    assert quality_model.classify(nothing, model).count() == 0
    assert quality_model.fit(docs, labels.filter("quality = 5")).limits[None] == float("inf")


def test_thresholds_come_from_all_trusted_rows(spark):
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in ("the", "an", "er", "re") for b in ("tion", "ing", "ed", "es", "ly")]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(20, 80))), "xx" if i % 20 == 0 else "en") for i in range(1600)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels, trusted_rows=300, slack=1.0)
    assert "xx" in model.limits  # 5 of the sample's 100 held-out rows are of it, of all rows 80
    got = {r["doc_id"]: (r["perplexity"], r["limit"]) for r in quality_model.classify(docs, model).collect()}
    over = sum(p > limit + 1e-9 for p, limit in got.values())
    assert 1 <= over <= 0.008 * len(rows)  # the quantile itself, without slack


def test_the_model_is_fitted_on_all_trusted_rows(spark):
    """Every row has a word of its own; all but the held-out third, and repeats of an id once, are in the n-grams."""
    rows = [(i, f"{i:05d} the {i:05d}", "en") for i in range(6000)] + [(8, "00008 the 00008", "en")] * 3
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(frame(spark, rows), labels)
    held = {i for i in range(6000) if zlib.crc32(str(i).encode()) % quality_model.HELD_OUT_PART == 0}
    last = {g for i in range(6000) if i not in held for g in quality_model.word_grams([f"{i:05d}".encode()])[0].tolist()}
    last |= set(quality_model.word_grams([b"the"])[0].tolist())
    assert model.grams.grams[-1].tolist() == sorted(last)


def test_grams_are_added_up_in_parts(monkeypatch):
    """A task that holds few n-grams hands on the same counts."""
    texts = [" ".join(f"w{j % 7}x{i % 11}" for j in range(20)) for i in range(50)]
    batch = quality_model.pa.RecordBatch.from_arrays([quality_model.pa.array(texts)], names=["text"])

    def counted():
        out = Counter()
        for part in quality_model._count_grams(3)(iter([batch, batch])):
            for g, c in zip(*(column.to_pylist() for column in part.columns)):
                out[g] += c
        return out

    whole = counted()
    monkeypatch.setattr(quality_model, "HELD_GRAMS", 5)
    monkeypatch.setattr(quality_model, "COUNTED_BYTES", 100)
    assert counted() == whole
    want = Counter()
    for t in texts * 2:
        for w in t.split():
            want.update(quality_model.word_grams([w.encode()], 3)[0].tolist())
    assert whole == want


def plain_ppm(texts, depth):
    """log10 probability of a text's bytes, by the trie of `texts` with their counts."""
    head = b"\0" * (depth - 1) + b" "
    trie = defaultdict(Counter)
    for text in texts:
        data = head + text
        for at in range(depth, len(data)):
            for k in range(depth + 1):
                trie[data[at - k : at]][data[at]] += 1

    def log(data, at):
        out, gone = 0.0, set()
        for k in range(depth, -1, -1):
            left = {s: n for s, n in trie.get(data[at - k : at], {}).items() if s not in gone}
            total = sum(left.values()) + len(left)
            if data[at] in left:
                return out + math.log10(left[data[at]] / total)
            if left:
                out += math.log10(len(left) / total)
                gone |= set(left)
        return out - math.log10(256 - len(gone))

    return lambda text: sum(log(head + text, at) for at in range(depth, depth + len(text)))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "part_grams": 7}, {"depth": 3}, {"depth": 6, "part_grams": 50}])
def test_ppm_against_its_definition(spark, options):
    rnd = random.Random(3)
    rows = [(i, " ".join("".join(rnd.choices("abcÉD", k=rnd.randint(1, 7))) for _ in range(rnd.randint(0, 25))), "en") for i in range(60)]
    rows += [(100 + k, t, lang) for k, (i, t, lang) in enumerate(EDGES)] + [(None, "abc abc", "en"), ((1 << 60) + 1, "abc", "en")]
    got = ppm.score(frame(spark, rows), **options).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
    tokens = {i: [*(t or "").encode().lower().split(), ppm.END] for i, t, _ in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    log = plain_ppm([b" ".join(ws) for i, ws in tokens.items() if not held[i]], options.get("depth", ppm.DEPTH))
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r["score"] == pytest.approx(log(b" ".join(ws)), rel=1e-9)


def test_ppm_steps_do_not_change_the_grams(monkeypatch):
    texts = [b"\n", b"abcdefgh ij \n", b"a \n", b"xy" * 40 + b" \n"]
    whole = [np.concatenate(x) for x in zip(*ppm.coded_grams(texts, 5))]
    monkeypatch.setattr(ppm, "STEP", 7)
    steps = [np.concatenate(x) for x in zip(*ppm.coded_grams(texts, 5))]
    assert all((a == b).all() for a, b in zip(whole, steps))
    assert [bytes([g & 255]) for g in whole[0]] == [bytes([c]) for t in texts for c in t]


def test_ppm_sees_the_order_of_words(spark):
    rnd = random.Random(4)
    follows = {w: rnd.sample("the old man saw a small boat near his house and went home".split(), 2) for w in "the old man saw a small boat near his house and went home".split()}

    def text():
        words = ["the"]
        while len(words) < 60:
            words.append(rnd.choice(follows[words[-1]]))
        return words

    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 1][:40]
    rows = [(i, " ".join(text()), "en") for i in range(3000) if zlib.crc32(str(i).encode()) % 5 != 1][:200]
    pairs = [(i, text()) for i in held]
    rows += [(i, " ".join(words), "en") for i, words in pairs[::2]] + [(i, " ".join(sorted(words)), "en") for i, words in pairs[1::2]]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in ppm.score(frame(spark, rows)).collect() if r["held_out"]}
    assert min(got[i] for i in held[::2]) > max(got[i] for i in held[1::2])


def test_ppm_of_nothing(nothing):
    assert ppm.score(nothing).count() == 0


def test_one_pass_gives_the_verdicts_of_fit_and_classify(spark, edges, nothing):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices("the of and to in is that for was with".split(), k=40)), "en" if i % 2 else "de") for i in range(300)]
    rows += [(1000 + i, "".join(rnd.choices("qzxjkw#", k=80)), "en") for i in range(20)] + [(5, "the same id again", "en")] * 40
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    key = lambda r: str(r)
    whole = [tuple(r) for r in quality_model.classify(docs, quality_model.fit(docs, labels, trusted_rows=100)).collect()]
    once = [tuple(r) for r in quality_model.fit_and_classify(docs, labels, trusted_rows=100).collect()]
    assert [r[4] for r in sorted(once, key=key)] == [r[4] for r in sorted(whole, key=key)]
    assert np.allclose([r[2] for r in sorted(once, key=key)], [r[2] for r in sorted(whole, key=key)])
    kept = quality_model.fit_and_keep(docs, labels, trusted_rows=100)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in whole if r[4])
    assert quality_model.fit_and_keep(edges, labels).columns == edges.columns and quality_model.fit_and_classify(nothing, labels).count() == 0


def test_a_repeated_id_is_one_trusted_row(spark, monkeypatch):
    seen = []
    grams = quality_model.fit_grams
    monkeypatch.setattr(quality_model, "fit_grams", lambda trusted: seen.append(trusted.count()) or grams(trusted))
    docs = frame(spark, [(7, f"text number {i}", "en") for i in range(500)])
    quality_model.fit(docs, spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"), trusted_rows=4)
    assert seen[0] <= 1
