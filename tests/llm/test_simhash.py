import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from llm_cases import EDGES, frame
from threadloom.llm import simhash
from threadloom.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(prints, radius):
    """Smallest member number of every one's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    rnd = random.Random(1)
    for _ in range(60):
        text = " ".join(rnd.choice(["A", "b", "Cé", "d\t", "日本"]) for _ in range(rnd.randint(0, 30)))
        assert simhash.fingerprint(text.encode()) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("fine", [10**9, 0])
def test_block_forests_span_all_links(monkeypatch, fine):
    monkeypatch.setattr(simhash, "FINE_PAIRS", fine)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 12)] + [base]))
    for a, b in ((near, None), (near[::2], near[1::2])):
        node, root = simhash.block_forest(a, a if b is None else b, 3)
        every = a if b is None else np.concatenate([a, b])
        parent = {int(x): int(x) for x in every} | {int(n): int(r) for n, r in zip(node, root)}
        for x in a:
            for y in a if b is None else b:
                if (int(x) ^ int(y)).bit_count() <= 3:
                    assert parent[int(x)] == parent[int(y)]
        if b is None:
            assert len(set(parent.values())) == len(set(groups([int(x) for x in a], 3)))


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    cycle = [(200, 201), (201, 202), (202, 200), (200, 200), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*chain, *star, *cycle, (None, 7)], "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 160)} | {201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_rows", [simhash.BLOCK_ROWS, 3])
def test_all_rows_against_brute_force(spark, block_rows):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=120)) for _ in range(40)]
    for _ in range(60):
        t = rnd.choice(texts[:6]).split()
        t[rnd.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    rows = [(i, t, "en") for i, t in enumerate([*texts, None, "", "a b", "a  b"])]
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    least = groups(prints, 3)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows), block_rows=block_rows).collect()}
    assert got == {i: (prints[i], least[i]) for i in range(len(rows))} and len(set(least)) < 90


def test_edges(edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[2] == by[3] == 1 and by[6] == 5
    kept = simhash.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "7", "8", "9", "None"])
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


def test_one_row_per_component_with_null_and_repeated_ids(spark):
    rnd = random.Random(8)
    a, b, c = (" ".join(rnd.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(3))
    rows = [(None, a, "en"), (None, a, "en"), (None, a.upper(), "en"), (7, b, "en"), (None, b, "en"), (7, c, "en"), (8, c, "en")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a.upper()), (7, b), (7, c)], key=str)
