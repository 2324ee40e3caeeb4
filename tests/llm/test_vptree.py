import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, rank int, shard string"


def plain(vectors, every, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(ids[j], float(score[j])) for j in order]
    return out


def found(df, **options):
    out = {}
    for r in sorted(vptree.nearest(df, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_rows": 3, "leaf": 4}, {"leaf": 2}])
def test_factor_one_is_exact(spark, options):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[::3] = x[0]  # a third are copies
    x[5] *= 40  # a long vector
    rows = [(i, [float(v) for v in r], 1, "s") for i, r in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, SCHEMA), every=10, k=7, **options), plain(dict((r[0], r[1]) for r in rows), 10, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_smaller_factors_visit_less_and_recall_stays(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.3
    tree = vptree.VantageTree(x, leaf=16)
    q = x[:50]
    seen = {}
    for factor in (1.0, 0.5):
        search = vptree.Search(tree, q, 10, factor, np.full(50, -1))
        seen[factor] = [set(r) for r in search.rows]
    exact = [set(np.argsort(((x - v) ** 2).sum(axis=1))[:10]) for v in q]
    assert seen[1.0] == exact
    assert np.mean([len(a & b) / 10 for a, b in zip(seen[0.5], exact)]) >= 0.9


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1, "s"), (20, [0.0, 0.0], 1, "s"), (40, None, 1, "s"), (60, [nan, 1.0], 1, "s"), (80, [None, 1.0], 1, "s"), (None, [1.0, 1.0], 1, "s"), (3, [2.0, 0.0], 1, "s"), (3, [2.0, 0.0], 1, "s"), (4, [1.0, 2.0, 3.0], 1, "s"), (5, [], 1, "s"), (100, [float("inf"), 1.0], 1, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == {0: [(3, 2.0), (3, 2.0)]}  # every row is a candidate, also one that is there twice
    assert vptree.nearest(df.filter(F.lit(False))).count() == 0


def held_against_plain(spark, vectors, **options):
    rows = [(int(i), [float(v) for v in r], 1, "s") for i, r in vectors.items()]
    got, want = found(spark.createDataFrame(rows, SCHEMA), every=10, k=7, **options), plain(vectors, 10, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q


@pytest.mark.parametrize("options", [{"leaf": 4}, {"shard_rows": 60, "leaf": 8}])
def test_ties_of_distinct_vectors_go_to_the_smaller_id(spark, options):
    rng = np.random.default_rng(5)
    x = np.zeros((400, 12))
    x[:, :3] = rng.integers(0, 2, (400, 3))  # few distinct products
    x[:, 3:] = rng.integers(0, 9, (400, 9))
    x[::10, 3:] = 0  # queries are zero where the others differ
    x[:, 0] += x.sum(axis=1) == 0
    held_against_plain(spark, dict(zip(rng.permutation(400), x)), **options)


@pytest.mark.parametrize("largest", [1e6, 1e8])
def test_one_long_vector_spoils_no_query(spark, largest):
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (400, 6)) / 64  # products are exact, whatever the order of the sums
    x[:, 5] = 0
    x[x.sum(axis=1) == 0, 0] = 1
    x[7] = [0, 0, 0, 0, 0, largest]
    held_against_plain(spark, dict(enumerate(x)), leaf=4)


def test_a_row_given_twice_comes_twice(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.8, 0.0]), (2, [0.1, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(df, k=4).orderBy("rank").collect()]
    assert got == [(1, 1, 0.9), (2, 1, 0.9), (3, 1, 0.9), (4, 2, 0.8)]
