"""Many k-means fits at once: against plain Lloyd rounds and MLlib's silhouette."""

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from threadloom.operators import clustering, models


def blobs(n, seed=2):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(5, 6)) * 6)[rng.integers(0, 5, n)] + rng.normal(size=(n, 6))


def dense(spark, x):
    return models.dense_features(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3), "id", "v")


def far(x, centres):
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2)


def test_fits_rest_at_means_and_costs_are_theirs(spark):
    x = blobs(400)
    rows = dense(spark, x)
    table, fitted = models.kmeans_sweep(rows, ks=(3, 5), starts=2)
    judge = ClusteringEvaluator(featuresCol="features", metricName="silhouette")
    for r in table.collect():
        c = fitted[r["k"]].centres
        nearest = far(x, c).argmin(axis=1)
        assert np.allclose([x[nearest == j].mean(axis=0) for j in range(r["k"])], c, atol=1e-3)
        assert np.isclose(far(x, c).min(axis=1).sum(), min(r["costs"])) and len(r["costs"]) == 2
        assert r["sizes"] == sorted(np.bincount(nearest, minlength=r["k"]).tolist())
        predicted = fitted[r["k"]].transform(rows)
        assert abs(judge.evaluate(predicted.withColumn("prediction", F.col("prediction").cast("double"))) - r["silhouette"]) < 1e-4


def test_sparse_rows_give_what_dense_ones_give(spark):
    x = np.where(np.abs(blobs(300)) > 3, blobs(300), 0.0)
    entries = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    sparse = spark.createDataFrame(entries, "id long, term_ids array<int>, weights array<double>").repartition(3)
    table, fitted = models.kmeans_sweep(sparse, ks=(4,), starts=2, size=6)
    r = table.first()
    assert sum(r["sizes"]) == 300 and np.isclose(far(x, fitted[4].centres).min(axis=1).sum(), min(r["costs"]))


def test_all_fits_share_a_pass(spark, monkeypatch):
    seen, one = [], clustering._one_pass
    monkeypatch.setattr(clustering, "_one_pass", lambda rows, fits, size: seen.append(len(fits)) or one(rows, fits, size))
    clustering.sweep(dense(spark, blobs(200)), ks=(3, 4, 5), starts=2, rounds=6)
    assert seen[0] == seen[-1] == 6 and len(seen) <= 7


def test_few_and_equal_rows(spark):
    same = models.kmeans_sweep(dense(spark, np.ones((5, 2))), ks=(3,), starts=1)[0].first()
    assert sum(same["sizes"]) == 5 and same["costs"] == [0.0]
    none = models.kmeans_sweep(dense(spark, np.ones((1, 2))).limit(0), ks=(2,), starts=1)[0].first()
    assert none["sizes"] == [0, 0] and none["silhouette"] is None
