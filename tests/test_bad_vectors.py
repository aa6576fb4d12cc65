"""Rows that can't be compared are errors everywhere, never other rows' neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.operators import builders as B
from veclode.operators import kmeans, knn
from veclode.operators import quantizers as Q

BAD = {"null": None, "short": [1.0], "long": [1.0, 2.0, 3.0], "null element": [1.0, None], "nan": [1.0, float("nan")], "infinite": [float("inf"), 1.0]}


def rows(spark, bad):
    good = [(0, [0.0, 0.0]), (2, [5.0, 5.0]), (3, [9.0, 9.0]), (4, [1.0, 7.0])]
    return spark.createDataFrame([good[0], (1, bad), *good[1:]], "vec_id long, embedding array<double>").coalesce(1)


@pytest.mark.parametrize("name", sorted(BAD))
@pytest.mark.parametrize("blocks", [False, True])
def test_search(spark, monkeypatch, name, blocks):
    if blocks:
        monkeypatch.setattr(knn, "SENT", 0)
    b = rows(spark, BAD[name])
    q = spark.createDataFrame([(9, [5.0, 5.0])], "q_id long, embedding array<double>")
    with pytest.raises(Exception, match="finite numbers"):
        knn.exact(q, b, 2).collect()
    with pytest.raises(Exception, match="finite numbers"):  # as a query
        knn.exact(b.withColumnRenamed("vec_id", "q_id"), b.where("vec_id <> 1"), 2).collect()
    found = knn.exact(q, b.where("vec_id <> 1"), 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["dist"]) for r in found] == [(2, 0.0), (4, 20.0)]


@pytest.mark.parametrize("name", sorted(BAD))
def test_clustering_calibration_and_graphs(spark, name):
    b = rows(spark, BAD[name])
    start = np.array([[0.0, 0.0], [9.0, 9.0]])
    for job in (lambda: kmeans.Clustering(2, 1, start).fit(b), lambda: kmeans.assign(b.select("vec_id", F.col("embedding").alias("v")), start[None]).collect(), lambda: Q.fit("SQ8U", b), lambda: Q.fit("SQ8", b), lambda: B.Index("NSG", R=4).build(b)):
        with pytest.raises(Exception, match="finite"):
            job()


def test_matrix_of_a_sliced_column():
    import pyarrow as pa

    from veclode.functions.vectors import matrix

    x = pa.array([[1.0], [2.0, 3.0], [4.0, 5.0], [6.0]])
    assert matrix(x[1:3], 2).tolist() == [[2.0, 3.0], [4.0, 5.0]] and matrix(x[:0], 2).shape == (0, 2)
    assert matrix(pa.chunked_array([x[1:2], x[2:3]]), 2).tolist() == [[2.0, 3.0], [4.0, 5.0]]
    assert matrix(pa.array([[1e308, 1e308]]), 2).tolist() == [[1e308, 1e308]]  # finite, though their sum isn't
