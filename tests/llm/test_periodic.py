import hashlib
import random
import zlib

import numpy as np
import pytest

from llm_cases import EDGES, frame
from threadloom.llm import periodic


def plain_runs(x, least=12):
    """Every maximal stretch per distance, largest distance first, so that the smallest one stays."""
    n, best = len(x), {}
    for q in range(n // 2, 0, -1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                best[start, i + q] = q
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs))


def random_words(rnd, most):
    n, kinds = rnd.randrange(most), rnd.choice([1, 2, 2, 3, 5, 30])
    x = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(rnd.randrange(3)):
        if n > 4:
            a = rnd.randrange(n)
            p, end = 1 + rnd.randrange(1 + (n - a) // 2), rnd.randrange(a, n + 1)
            x = [x[i] if i < a or i >= end else x[a + (i - a) % p] for i in range(n)]
    return x


def test_runs_equal_brute_force():
    rnd = random.Random(3)
    for k in range(1500):
        x = random_words(rnd, 250 if k % 10 else 900)
        assert list(map(tuple, periodic.find_runs(np.array(x, np.int64)).tolist())) == plain_runs(x), x


@pytest.mark.parametrize("shape", ["one word", "stretches", "squares of squares", "fibonacci"])
def test_special_words(shape):
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    text = {
        "one word": "a" * 700, "stretches": "".join("a" * k + "b" for k in (90, 31, 64, 90, 33, 64, 128)),
        "squares of squares": ("ab" * 7 + "c" * 13) * 6 + "ab" * 3, "fibonacci": fib[-1],
    }[shape]
    x = np.frombuffer(text.encode(), np.uint8).astype(np.int64) - 97
    assert list(map(tuple, periodic.find_runs(x).tolist())) == plain_runs(x.tolist())


@pytest.mark.parametrize("block,least,most,high", [(2, 1, 6, 3), (4, 7, 14, 5), (64, 127, 254, 70_000), (256, 511, 1022, 2)])
def test_zeros_of_squared_differences(block, least, most, high):
    rnd = np.random.default_rng(block)
    x = rnd.integers(0, high, 3000)
    for d in (least, most, least + 3):
        at = int(rnd.integers(0, 1500))
        x[at + d : at + d + block] = x[at : at + block]
    starts = np.arange(0, len(x) - block + 1)
    got = set(zip(*map(np.ndarray.tolist, periodic.zero_mismatches(x, starts, block, least, most))))
    rows = lambda at: x[at[:, None] + np.arange(block)]
    want = set()
    for d in range(least, most + 1):
        fits = starts[starts + d + block <= len(x)]
        want |= {(int(s), d) for s in fits[(rows(fits) == rows(fits + d)).all(axis=1)]}
    assert got == want and len(want) >= 1


def test_long_texts_of_one_loop_stay_fast():
    for x in (np.zeros(300_000, np.int64), np.arange(300_000) % 999):
        assert len(periodic.find_runs(x)) == 1


def plain_loops(doc_id, words):
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def check(df):
    rows = periodic.scan(periodic.with_loops(df)).collect()
    want = []
    for doc_id, text in ((r["doc_id"], r["text"]) for r in df.collect()):
        words = plain_loops(doc_id, [w.decode() for w in (text or "").encode().split()])
        runs = plain_runs(words)
        want.append((doc_id, len(words), [(s, e - s, q) for s, e, q in runs], plain_collapsed(words, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_documents(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([" ", "\n\t", "\x0b "]).join(f"w{w}" for w in random_words(rnd, 120)), "en") for i in range(150)]
    got = check(frame(spark, rows).repartition(3))
    assert any(r[2] for r in got)


def test_edges(spark):
    rows = [r for r in EDGES if r[0] != 8] + [(8, "long " * 900, "en"), (10, " a b " * 13, None), (55, " ".join(f"{i % 7}" for i in range(40)), "en")]
    got = {r[0]: r for r in check(frame(spark, rows))}
    assert got[8][2] == [(0, 900, 1)] and got[8][3] == "long" and got[1][1:] == (0, [], "")


def test_very_long_text(spark):
    row = periodic.scan(frame(spark, EDGES)).filter("doc_id = 8").first()
    assert [tuple(r) for r in row["runs"]] == [(0, 20_000, 1)]


def test_empty(nothing):
    assert check(nothing) == []


def test_digests(spark):
    found = periodic.scan(frame(spark, [(1, "a b " * 9 + "c " * 18, "en"), (2, "x", "en")]))
    rows = found.select("doc_id", periodic.longest_run(found.runs).alias("best"), periodic.runs_digest(found.runs).alias("d")).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert tuple(by_id[1]["best"]) == (0, 18, 2) and by_id[1]["d"] == hashlib.sha256(b"0,18,2\n18,18,1\n").hexdigest()
    assert by_id[2]["best"] is None and by_id[2]["d"] == hashlib.sha256(b"").hexdigest()
