"""The plain silhouette against distances of all pairs."""

import numpy as np
import pytest

from threadloom.operators.silhouette import plain_silhouette, silhouettes


def brute(x, c):
    x, c = np.asarray(x, float), np.asarray(c)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        if (c == c[i]).sum() == 1:
            out.append(0.0)
            continue
        mine = far[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        other = min(far[i, c == o].mean() for o in set(c.tolist()) - {c[i]})
        out.append((other - mine) / max(mine, other) if max(mine, other) else 0.0)
    return np.array(out)


def frame(spark, x, *clusters):
    rows = [([float(v) for v in r], *map(int, cs)) for r, *cs in zip(x, *clusters)]
    return spark.createDataFrame(rows, "v array<double>, " + ", ".join(f"c{i} int" for i in range(len(clusters))))


@pytest.mark.parametrize("tile_rows", [16, 1000])
def test_two_assignments_against_all_pairs(spark, tile_rows):
    rng = np.random.default_rng(4)
    c = rng.integers(0, 4, 150)
    x = rng.normal(size=(4, 5))[c] * 3 + rng.normal(size=(150, 5))
    x[10:30] = x[10]  # repeated, in all clusters
    x[31] = x[32] + 1e-9
    c[40], other = 9, rng.integers(0, 2, 150)  # alone in its cluster
    got = {(r["assignment"], r["cluster"]): (r["n"], r["silhouette"]) for r in plain_silhouette(frame(spark, x, c, other), "v", ["c0", "c1"], tile_rows).collect()}
    for name, of in (("c0", c), ("c1", other)):
        want = brute(x, of)
        assert got.pop((name, None)) == (150, pytest.approx(want.mean(), abs=1e-9))
        for k in set(of.tolist()):
            assert got.pop((name, str(k))) == ((of == k).sum(), pytest.approx(want[of == k].mean(), abs=1e-9))
    assert not got


def test_pairs_of_tiles_are_dealt_to_all_cores(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(2600, 2)) + 1e5, rng.integers(0, 3, 2600)
    x[1300:1400] = x[:100] + 1e-7  # near each other, in any tile
    each = silhouettes(frame(spark, x, c), "v", ["c0"])
    assert each.rdd.getNumPartitions() > 1  # 8,192 rows were one task
    got = {(tuple(r["x"]), r["clusters"][0]): r["scores"][0] for r in each.collect()}
    want = brute(x, c)
    assert len(got) == 2600 and max(abs(got[tuple(v), str(k)] - w) for v, k, w in zip(x.tolist(), c, want)) < 1e-8


def test_edges(spark):
    one = plain_silhouette(frame(spark, [[1.0], [2.0]], [5, 5]), "v", ["c0"]).collect()
    assert {r["silhouette"] for r in one} == {None} and {r["n"] for r in one} == {2}
    same = plain_silhouette(frame(spark, [[1.0]] * 4, [0, 0, 1, 1]), "v", ["c0"]).collect()
    assert {r["silhouette"] for r in same} == {0.0}
    assert plain_silhouette(frame(spark, [[1.0]], [0]).limit(0), "v", ["c0"]).count() == 0
    odd = spark.createDataFrame([([1.0], 0), ([None], 0), (None, 1), ([float("nan")], 1), ([3.0], None), ([float("inf")], 0)], "v array<double>, c0 int")
    assert [r["n"] for r in silhouettes(odd, "v", ["c0"]).collect()] == [1]
    with pytest.raises(ValueError):
        silhouettes(frame(spark, [[1.0], [1.0, 2.0]], [0, 1]), "v", ["c0"])
