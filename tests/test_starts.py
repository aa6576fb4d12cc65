"""Starts by oversampling, and what fit, predict and transform do with options."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.operators import kmeans, knn
from veclode.operators import quantizers as Q


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def doubled(b):
    return b.select("vec_id", F.col("embedding").alias("v"))


def loss(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_starts_spread_over_clusters(spark):
    r = np.random.default_rng(1)
    at = r.normal(size=(20, 6)) * 100
    x = np.concatenate([a + r.normal(size=(3 if i else 600, 6)) for i, a in enumerate(at)])  # one cluster holds almost all rows
    b = table(spark, x)
    c = kmeans.spread(doubled(b), 20, 1, 6)[0]
    assert len(set(((c[:, None] - at[None]) ** 2).sum(2).argmin(1))) == 20
    assert (kmeans.spread(doubled(b.repartition(7)), 20, 1, 6)[0] == c).all()
    assert loss(x, kmeans.Clustering(20, 3, "kmeans++").fit(b).centroids) < 0.01 * loss(x, kmeans.Clustering(20, 3, "random").fit(b).centroids)


def test_passes_do_not_grow_with_k(spark, monkeypatch):
    b, n = doubled(table(spark, np.random.default_rng(2).normal(size=(300, 8)))), []
    for k in (4, 64):
        spark.sparkContext.setJobGroup(f"k{k}", "")
        kmeans.spread(b, k, 2, 4)
        n.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"k{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(n[0] - n[1]) <= 2 and max(n) < 30


def test_few_distinct_values(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0]] * 10)
    c = kmeans.spread(doubled(table(spark, x)), 4, 2, 1)
    assert {*c[0].ravel()} == {1.0, 2.0} and {*c[1].ravel()} == {5.0}
    with pytest.raises(ValueError, match="distinct"):
        kmeans.Clustering(3, 1, "kmeans++").fit(table(spark, x))
    z = Q.fit("PQ8", table(spark, np.random.default_rng(3).normal(size=(30, 8))))
    assert z.codebook.shape == (2, 30, 4)


def test_product_codes_with_wide_candidates(spark):
    x = np.random.default_rng(4).normal(size=(900, 32))
    b = table(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    q = b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    truth, z = knn.exact(q, b, 10, others=True), Q.fit("PQ8", b)
    share = lambda f: knn.recall(knn.two_stage(q, b, 10, "L2", z, others=True, factor=f), truth, 10).first()["recall"]
    assert share(5.0) >= 0.95 > share(None) - 0.2


def test_spherical_centroids_and_samples(spark):
    x = np.random.default_rng(5).normal(size=(200, 5))
    b = table(spark, x)
    c = kmeans.Clustering(4, 2, x[:4], spherical=True).fit(b).centroids
    plain = kmeans.Clustering(4, 2, x[:4]).fit(b).centroids
    assert np.allclose(c, plain / np.linalg.norm(plain, axis=1, keepdims=True)) and np.allclose(np.linalg.norm(c, axis=1), 1)
    zero = kmeans.Clustering(2, 1, np.array([x.mean(0), np.full(5, 1e3)]), spherical=True).fit(b).centroids
    assert (zero[1] == 0).all()  # an empty cluster has no direction
    few = kmeans.Clustering(3, 2, "random", sample=50)
    again = kmeans.Clustering(3, 2, "random", sample=50)
    assert (few.fit(b).centroids == again.fit(b.repartition(5)).centroids).all()
    rows = few.fit(b).predict(b).count()
    assert rows == 200 and abs(few.loss(b).first()["loss"] - loss(x, few.centroids)) < 1e-6
