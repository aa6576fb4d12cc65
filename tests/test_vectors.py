import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.functions import vectors as V
from veclode.functions.order import kth_smallest
from veclode.operators import builders as B
from veclode.operators import graph as G
from veclode.operators import kmeans, knn
from veclode.operators import quantizers as Q
from veclode.operators.searcher import Searcher


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(1).normal(size=(200, 8))


def test_tiny_line_and_ties(spark):
    b = table(spark, [[0.0], [1.0], [2.0], [4.0], [8.0], [1.0]])
    q = spark.createDataFrame([(0, [1.0])], "q_id long, embedding array<double>")
    got = [tuple(r) for r in knn.exact(q, b, 4).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 5, 0.0), (0, 3, 0, 1.0), (0, 4, 2, 1.0)]


def brute(q, x, k, kind="L2"):
    """Distances summed in order, ties by id."""
    out = []
    for v in q:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (v[j] - x[:, j]) ** 2 if kind == "L2" else v[j] * x[:, j]
        d = d if kind == "L2" else -d
        out.append([(int(i), float(d[i])) for i in np.lexsort((np.arange(len(x)), d))[:k]])
    return out


def nearest_rows(found):
    by = {}
    for r in found.orderBy("q_id", "rank").collect():
        by.setdefault(r["q_id"], []).append((r["vec_id"], r["dist"]))
    return [by[k] for k in sorted(by)]


def near_ties(r):
    tiny = np.ones((40, 3)) + np.array([[(40 - i) * 1e-9, 0, 0] for i in range(40)])  # differ far below single precision
    large = 1e6 + r.normal(size=(60, 3)) * 1e-3  # large norms: the matrix product cancels
    return np.concatenate((tiny, large, np.repeat(r.normal(size=(5, 3)), 9, axis=0), [[0.0] * 3] * 3))


@pytest.mark.parametrize("kind", ["L2", "IP"])
@pytest.mark.parametrize("blocks", [False, True])
def test_exact_on_near_ties(spark, monkeypatch, kind, blocks):
    x = near_ties(np.random.default_rng(7))
    q = np.concatenate(([[1.0, 1.0, 1.0]], x[40:44] + 1e-4, x[100:103], [[0.0] * 3]))
    if blocks:  # more queries than are sent: pairs of blocks
        monkeypatch.setattr(knn, "SENT", 0)
        monkeypatch.setattr(knn, "BLOCK", 100)
    queries = table(spark, q).withColumnRenamed("vec_id", "q_id")
    for k in (3, 12):
        assert nearest_rows(knn.exact(queries, table(spark, x), k, kind)) == brute(q, x, k, kind)


def test_knn_graph_in_blocks(spark, data, monkeypatch):
    b = G.doubled(table(spark, data))
    whole = sorted(map(tuple, B.knn_graph(b, 4).collect()))
    monkeypatch.setattr(knn, "SENT", 0)
    monkeypatch.setattr(knn, "BLOCK", 2000)
    assert sorted(map(tuple, B.knn_graph(b, 4).collect())) == whole


def test_k_beyond_rows_and_empty(spark):
    b = table(spark, [[0.0], [1.0]])
    q = b.select(F.col("vec_id").alias("q_id"), "embedding")
    assert knn.exact(q, b, 10, others=True).count() == 2
    assert knn.exact(q.where("false"), b, 3).count() == 0
    assert knn.exact(q, b.where("false"), 3).count() == 0


def test_grids_match_numpy(spark):
    x = [s * m for s in (1.0, -1.0) for m in (*(2.0**e for e in range(-26, 15)), 0.1, 1.7, 3.3e-5, 7.3e-8, 65000.0)] + [0.0]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", V.fp16(F.col("x")).alias("h"), V.e5m2(F.col("x")).alias("e"))
    for r in df.collect():
        h = np.float16(r["x"])
        cut = np.frombuffer(np.uint16(h.view(np.uint16) & 0xFF00).tobytes(), np.float16)[0]
        assert r["h"] == float(h), r
        assert r["e"] == float(cut), r


@pytest.mark.parametrize("bits", [1, 2, 4, 6])
def test_pack_round_trip(spark, bits):
    codes = [i % 2**bits for i in range(7)]
    df = spark.createDataFrame([(codes,)], "c array<int>")
    assert df.select(V.unpacked(V.packed(F.col("c"), bits), bits, 7).alias("x")).first()["x"] == codes


def test_constant_dimension_gives_code_zero(spark):
    b = table(spark, [[1.0, 5.0], [2.0, 5.0], [3.0, 5.0]])
    z = Q.fit("SQ8", b)
    assert [r["c"] for r in b.select(z.encode(F.col("embedding")).alias("c")).collect()] == [[0, 0], [128, 0], [255, 0]]


def test_names():
    assert Q.known("FP8_E5M2") == "E5M2" and Q.known("BinaryQuant") == "SQ1"
    for bad in (lambda: Q.known("nope"), lambda: V.metric("cosine"), lambda: B.Index("tree"), lambda: kmeans.Clustering(2, init="x"), lambda: B.Index("NSG", quant="SQ8")):
        with pytest.raises(ValueError):
            bad()


def test_order_statistic_narrows(spark, monkeypatch):
    from veclode.functions import order

    monkeypatch.setattr(order, "SORTED", 50)
    x = np.random.default_rng(2).integers(0, 300, 2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 17, 1000, 1999, 2000):
        assert kth_smallest(df, "x", k) == float(np.sort(x)[k - 1])


@pytest.mark.parametrize("top", [1, 2, 17, 400])
def test_trimmed_limits_of_each_dimension(spark, top):
    r = np.random.default_rng(5)
    x = np.stack([r.normal(size=300), r.integers(0, 4, 300), np.full(300, 2.5), np.exp(r.normal(size=300) * 20)], axis=1)
    got = Q.per_dim_limits(table(spark, x), top)
    k = min(top, 300)
    assert got == {j: (float(np.sort(x[:, j])[k - 1]), float(np.sort(x[:, j])[-k])) for j in range(4)}


@pytest.mark.parametrize("scale", [1e-11, 1.0, 1e10])
def test_means_keep_their_size(spark, data, scale):
    b = table(spark, data * scale)
    c = kmeans.Clustering(2, 1, data[:2] * scale).fit(b).centroids
    near = ((data[:, None] - data[None, :2]) ** 2).sum(2).argmin(1)
    expected = np.array([data[near == k].mean(0) for k in (0, 1)]) * scale
    assert np.allclose(c, expected, rtol=1e-9, atol=1e-12 * scale)
    m = G.medoid(b).first()
    assert m["ep"] == int(((data - data.mean(0)) ** 2).sum(1).argmin())


def test_levels_of_any_id(spark):
    ids = [0, 1, 2**40, 2**62, -5]
    got = [r["x"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(B.level(F.col("i"), 8).alias("x")).collect()]
    assert all(0 <= x < 20 for x in got)
    n = spark.range(4000).select(B.level(F.col("id"), 8).alias("x")).groupBy("x").count().collect()
    assert 3300 < {r["x"]: r["count"] for r in n}[0] < 3700


@pytest.mark.parametrize("quant", ["FP16", "BF16", "SQ8U"])
def test_builds_are_on_what_codes_stand_for(spark, quant):
    b = table(spark, [[0.1, -0.3], [0.7, 0.2]])
    rows, _ = B.Index("NSG", quant=quant).vectors(b)
    got = {r["vec_id"]: r["v"] for r in rows.collect()}
    if quant == "FP16":
        assert got[0] == [float(np.float16(0.1)), float(np.float16(-0.3))]
    elif quant == "BF16":
        assert got[0] == [0.10009765625, -0.30078125]
    else:
        assert all(x == int(x) and 0 <= x <= 127 for v in got.values() for x in v)


def test_grown_keeps_the_cap_and_attaches_many_at_once(spark):
    x = [[float(i), 0.0] for i in range(30)] + [[1000.0 + i, 0.0] for i in range(10)]
    b = G.doubled(table(spark, x))
    e = B.knn_graph(b, 1)  # many islands of two
    ep = spark.createDataFrame([(0,)], "ep long")
    out = G.grown(e, ep, b, 3)
    assert G.reachable(out, ep.withColumnRenamed("ep", "vec_id")).count() == 40
    assert out.groupBy("src").count().agg(F.max("count")).first()[0] <= 3


def test_hnsw_by_dot_product(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 6)) * r.uniform(0.2, 3.0, size=(150, 1))  # lengths differ, so the metrics do
    b = table(spark, x)
    g = B.Index("HNSW", "IP", R=12, L=24).build(b)
    q = b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    s = Searcher(g, b, "IP")
    s.set_ef(48)
    found = s.batch_search(q, 5)
    assert knn.recall(found, knn.exact(q, b, 5, "IP"), 5).first()["recall"] >= 0.9
    d = {(a["src"], a["dst"]): a["dist"] for a in g.edges.collect()}
    assert all(abs(v + x[i] @ x[j]) < 1e-9 for (i, j), v in d.items())
    n = s.get_last_search_dist_cmps()
    assert 5 <= n <= 150


def test_product_quantizer_recall(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    b = table(spark, x)
    z = Q.fit("PQ8", b)
    assert z.codebook.shape == (4, 256, 4)
    q = b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    truth = knn.exact(q, b, 10)
    assert knn.recall(knn.two_stage(q, b, 10, "L2", z), truth, 10).first()["recall"] >= 0.85
    code = {r["vec_id"]: r["c"] for r in b.select("vec_id", z.encode(F.col("embedding")).alias("c")).collect()}
    for i in (0, 17, 599):
        assert code[i] == [int(((z.codebook[s] - x[i, 4 * s : 4 * s + 4]) ** 2).sum(1).argmin()) for s in range(4)]


def test_benchmark_keeps_its_index(spark, data, tmp_path):
    from veclode.operators.searcher import Benchmark

    b = table(spark, data[:80])
    q = b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    config = {"index": "NSG", "R": 8, "L": 20, "build_quant": "FP32", "efs": [10, 40], "runs": 1, "k": 5}
    one = Benchmark(config, f"file://{tmp_path}/indexes").fit(b)
    two = Benchmark(config, f"file://{tmp_path}/indexes").fit(b)
    assert one.seconds and two.seconds is None
    rows = two.sweep(q, knn.exact(q, b, 5), f"file://{tmp_path}/sweep")
    assert [r["ef"] for r in rows.orderBy("ef").collect()] == [10, 40] and spark.read.option("header", True).csv(f"file://{tmp_path}/sweep").count() == 2
    two.set_query_arguments(40)
    assert two.query(q).count() == 20
    g = two.searcher.graph
    assert g.size() == 80 and g.range() <= 8 and g.degree(0) == g.neighbours(0).count() and g.at(0, 0) == g.neighbours(0).first()["dst"] and g.at(0, 99) is None
    with pytest.raises(ValueError):
        Benchmark({"speed": 1})


def test_kmeans_empty_cluster_and_plus_plus(spark, data):
    b = table(spark, data)
    c = kmeans.Clustering(2, 1, np.array([data.mean(0), np.full(8, 1e3)])).fit(b)
    assert (c.centroids[1] == 0).all()
    d = kmeans.Clustering(4, 3, "kmeans++").fit(b)
    near = ((data[:, None] - d.centroids[None]) ** 2).sum(2).argmin(1)
    assert [r["cid"] for r in d.predict(b).orderBy("vec_id").collect()] == near.tolist()


def test_nn_descent_recall(spark, data):
    b = table(spark, data)
    v = G.doubled(b)
    truth = {(r["src"], r["dst"]) for r in B.knn_graph(v, 5).collect()}
    got = {(r["src"], r["dst"]) for r in B.nn_descent(v, 5, iterations=4).collect()}
    assert len(truth & got) / len(truth) > 0.95


def test_nn_descent_progress(spark, data):
    v = G.doubled(table(spark, data[:120]))
    p = B.Progress(v, 5, nodes=30)
    B.nn_descent(v, 5, sample=4, iterations=3, progress=p)
    r = [x["recall"] for x in p.rows(spark).orderBy("round").collect()]
    assert len(r) == 4 and r == sorted(r) and r[0] < 0.5 and r[-1] > 0.8
    q = B.Progress(v, 5, nodes=30, gain=2.0)  # no round can gain that much
    B.nn_descent(v, 5, sample=4, iterations=3, progress=q)
    assert len(q.recalls) == 3 and q.recalls[1] == r[1]


@pytest.mark.parametrize("kind", ["NSG", "SSG", "HNSW", "RNNDESCENT"])
def test_index(spark, data, kind):
    b = table(spark, data[:60])
    g = B.Index(kind, R=8, L=12).build(b)
    e = [tuple(r) for r in g.edges.select("src", "dst").collect()]
    assert len(e) == len(set(e)) and all(a != c for a, c in e)
    if kind != "RNNDESCENT":
        assert G.reachable(g.edges, g.entries.select(F.col("ep").alias("vec_id"))).count() == 60
    q = b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    found = Searcher(g, b).batch_search(q, 5, others=True)
    assert knn.recall(found, knn.exact(q, b, 5, others=True), 5).first()["recall"] >= 0.9
    assert e and max(sum(a == x for a, _ in e) for x in range(60)) <= 8


def test_angle_rule_keeps_right_angles(spark):
    b = G.doubled(table(spark, [[0.0, 0.0], [1.0, 0.0], [0.0, 1.1], [1.2, 0.1]]))
    e = B.knn_graph(b, 3)
    keep = lambda angle: sorted(r["dst"] for r in G.pruned(e, b, 8, 8, angle).where("src = 0").collect())
    assert keep(True) == [1, 2] and keep(False) == [1, 2]
