"""Packed codes: their size, their round trip, and searches on them against the column expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.functions import vectors as V
from veclode.operators import codes, kmeans, knn
from veclode.operators import quantizers as Q


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


@pytest.fixture(scope="module")
def data():
    x = np.random.default_rng(1).normal(size=(400, 20))
    x[7] = x[8] = x[9]
    return x


CASES = [(n, m) for n in codes.BITS for m in ("L2", "IP") if (n, m) != ("SQ1", "L2")]


@pytest.mark.parametrize("name,metric", CASES)
def test_codes_hold_what_the_columns_say(spark, data, name, metric):
    b = table(spark, data)
    z = Q.fit(name, b, metric)
    v = V.doubles(F.col("embedding"))
    rows = codes.stored(b, z).join(b.select("vec_id", z.code_vector(z.encode(v), v).alias("expected")), "vec_id").collect()
    size = {"PQ8": 5, "SQ8P": 20 + 4}.get(name, -(-20 * codes.BITS[name] // 8))
    assert len(rows) == 400 and {len(r["code"]) for r in rows} == {size}
    raw = np.frombuffer(b"".join(bytes(r["code"]) for r in rows), np.uint8).reshape(400, -1)
    got = z.codebook[np.arange(5), raw].reshape(400, -1) if name == "PQ8" else codes.vectors(z, raw)
    assert (got[:, :20] == np.array([r["expected"] for r in rows])).all()


@pytest.mark.parametrize("name,metric", [("SQ1", "IP"), ("PQ8", "L2"), ("PQ8", "IP"), ("SQ8P", "L2"), ("SQ4U", "L2"), ("SQ6", "IP"), ("FP16", "L2")])
@pytest.mark.parametrize("blocks", [False, True])
def test_search_on_codes(spark, data, monkeypatch, name, metric, blocks):
    """A stored table, in one piece or in pairs of blocks, against distances in the order of the elements."""
    if blocks:
        monkeypatch.setattr(knn, "SENT", 0)
        monkeypatch.setattr(knn, "BLOCK", 5000)
        monkeypatch.setattr(codes, "BLOCK", 64)
        monkeypatch.setattr(codes.Tables, "KEPT", 0)
    b = table(spark, data)
    z, v = Q.fit(name, b, metric), V.doubles(F.col("embedding"))
    q = b.where("vec_id % 40 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    x = {r["vec_id"]: (r["q"], r["c"]) for r in b.select("vec_id", z.query_vector(v).alias("q"), z.code_vector(z.encode(v), v).alias("c")).collect()}
    bias = {r["vec_id"]: r["t"] for r in b.select("vec_id", (z.bias(v) if z.bias(v) is not None else F.lit(0.0)).alias("t")).collect()}
    found = knn.flat_codes(q, codes.stored(b, z), 7, z, others=True).orderBy("q_id", "rank").collect()
    for i in range(0, 400, 40):
        def dist(j):
            if name == "SQ8P":
                return bias[j] - sum(2 * a * c for a, c in zip(x[i][0], x[j][1], strict=True))
            terms = [(a - c) ** 2 if z.kind == "L2" else a * c for a, c in zip(x[i][0], x[j][1], strict=True)]
            s = 0.0
            for t in terms:
                s += t
            return s if z.kind == "L2" else -s

        expected = sorted((dist(j), j) for j in x if j != i)[:7]
        own = [(r["dist"], r["vec_id"]) for r in found if r["q_id"] == i]
        if name == "SQ8P":
            assert np.allclose([d for d, _ in own], [d for d, _ in expected]) and [j for _, j in own] == [j for _, j in expected]
        else:
            assert own == expected


def test_sign_bits_beyond_a_word(spark):
    x = np.random.default_rng(3).normal(size=(60, 131))
    b = table(spark, x)
    z = Q.fit("SQ1", b, "IP")
    q = b.where("vec_id < 4").select(F.col("vec_id").alias("q_id"), "embedding")
    s = x > 0
    for r in knn.flat(q, b, 5, z).collect():
        d = (s[r["q_id"]] != s).sum(axis=1)
        assert r["dist"] == d[r["vec_id"]] and r["vec_id"] == np.lexsort((np.arange(60), d))[r["rank"] - 1]


def test_lookup_tables_are_what_a_search_adds_up(spark, data):
    b = table(spark, data)
    z = Q.fit("PQ8", b)
    q = b.where("vec_id < 3").select(F.col("vec_id").alias("q_id"), "embedding")
    t = {(r["q_id"], r["sq"], r["k"]): r["dist"] for r in kmeans.lookup_tables(q, z.codebook).collect()}
    got = codes.Tables(z.codebook).of(data[:3], "L2")
    assert got.shape == (5, 256, 3) and all(abs(got[s, k, i] - d) < 1e-12 for (i, s, k), d in t.items())


def test_half_precision_has_a_range():
    with pytest.raises(ValueError, match="half precision"):
        codes.pack(np.array([[70000.0]]), "FP16")
