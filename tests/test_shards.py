"""Graphs in shards: insertion, one-pass search, further rows, layouts of graphs built elsewhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.operators import builders as B
from veclode.operators import graph as G
from veclode.operators import knn, shards
from veclode.operators import walk as W
from veclode.operators.searcher import Benchmark, Searcher, ShardSearcher


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def queries(b, each=20):
    return b.where(f"vec_id % {each} = 0").select(F.col("vec_id").alias("q_id"), "embedding")


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(1).normal(size=(300, 8))


def levels(n, m):
    return np.floor(-np.log(np.random.default_rng(2).random(n)) / np.log(m)).astype(int)


def check(shard, cap):
    links = shard.links[0]
    n = len(links)
    assert links.shape[1] == cap and (links < n).all() and not (links == np.arange(n)[:, None]).any()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in links) and W.reached(links, shard.entry).all()


@pytest.mark.parametrize("kind", ["L2", "IP"])
@pytest.mark.parametrize("shape", ["plain", "copies", "islands", "one", "none"])
def test_insertion(kind, shape):
    r = np.random.default_rng(3)
    x = {"plain": r.normal(size=(700, 6)), "copies": np.concatenate((np.ones((400, 6)), r.normal(size=(300, 6)))), "islands": np.concatenate([r.normal(size=(150, 6)) + 1e4 * k for k in range(4)]), "one": np.ones((1, 6)), "none": np.zeros((0, 6))}[shape]
    s = W.inserted(W.Shard(x), levels(len(x), 4), 4, 24, kind)
    check(s, 8)
    again = W.inserted(W.Shard(x), levels(len(x), 4), 4, 24, kind)
    assert all((a == b).all() for a, b in zip(s.links, again.links, strict=True)) and s.entry == again.entry
    if not len(x):
        return
    q = x[::37]
    d = ((q[:, None] - x[None]) ** 2).sum(2) if kind == "L2" else -(q @ x.T)
    ids, dist, n = W.search(s, q, len(x), kind)  # as wide as the shard: all nodes, in order
    assert (np.sort(ids, axis=1) == np.arange(len(x))).all() and np.allclose(dist, np.sort(d, axis=1), rtol=1e-9, atol=1e-6)
    assert (n >= len(x)).all()
    if shape == "plain":
        ids, _, n = W.search(s, q, 40, kind)
        truth = np.argsort(d, axis=1, kind="stable")[:, :10]
        assert np.mean([len({*a[:10]} & {*b}) for a, b in zip(ids, truth, strict=True)]) >= 9 and n.mean() < len(x)


def test_insertion_goes_on():
    x = np.random.default_rng(4).normal(size=(500, 6))
    lv = levels(500, 4)
    s = W.inserted(W.Shard(x[:350]), lv[:350], 4, 24, "L2")
    t = W.inserted(W.Shard(x, s.links, s.entry), lv, 4, 24, "L2", 350)
    check(t, 8)
    assert (lv[t.entry] == lv.max()) and (W.search(t, x[::50], 60, "L2")[0][:, 0] == np.arange(0, 500, 50)).mean() >= 0.9


def test_pruning_and_links_back_against_the_rule():
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 3))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    ids = np.argsort(d, axis=1, kind="stable")[:, 1:31]
    got, _ = W.pruned(x, ids, np.take_along_axis(d, ids, 1), 5, "L2")
    for i in range(60):
        kept = []
        for j in ids[i]:
            if len(kept) < 5 and all(d[j, k] >= d[i, j] for k in kept):
                kept.append(j)
        assert [k for k in got[i] if k >= 0] == kept
    links, dist = np.full((60, 4), -1), np.full((60, 4), np.inf)
    src = np.arange(1, 60)  # all lead to node 0: its list is pruned, not cut
    W._link_back(x, links, dist, src, np.zeros(59, int), d[src, 0], "L2")
    near = np.argsort(d[0], kind="stable")[1:5]
    want, _ = W.pruned(x, near[None], d[0][near][None], 4, "L2")
    assert sorted(links[0][links[0] >= 0]) == sorted(near if len(near) <= 4 else want[0][want[0] >= 0]) and (links[1:] == -1).all()


@pytest.mark.parametrize("blocks", [False, True])
def test_full_width_is_exact(spark, data, monkeypatch, blocks):
    b = table(spark, np.concatenate((data, np.repeat(data[:1], 120, axis=0))))  # a cell of equal rows, larger than a shard
    index = shards.hnsw(G.doubled(b), 8, 16, rows=60)
    assert index.nodes.groupBy("shard").count().agg(F.max("count")).first()[0] <= 130 and sum(map(len, index.shards)) >= 7
    if blocks:
        monkeypatch.setattr(knn, "SENT", 400)
    f = ShardSearcher(index, b)
    f.set_ef(200)
    got = sorted(map(tuple, f.batch_search(queries(b), 7, others=True).collect()))
    assert got == sorted(map(tuple, knn.exact(queries(b), b, 7, others=True).collect()))
    assert f.get_last_search_dist_cmps() >= 420


def test_probing_asks_the_nearest_cells(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(80, 5)) + 50 * k for k in range(5)])
    b = table(spark, x)
    index = shards.hnsw(G.doubled(b), 8, 16, rows=80)
    one, all_ = ShardSearcher(index, b, probe=1), ShardSearcher(index, b)
    truth = knn.exact(queries(b), b, 5, others=True)
    for f in (one, all_):
        f.set_ef(60)
        assert knn.recall(f.batch_search(queries(b), 5, others=True), truth, 5).first()["recall"] >= 0.95
    assert one.get_last_search_dist_cmps() < 0.6 * all_.get_last_search_dist_cmps()


def test_rows_are_added_to_a_saved_index(spark, data, monkeypatch, tmp_path):
    monkeypatch.setattr(shards, "ROWS", 100)
    b = table(spark, data)
    shards.hnsw(G.doubled(b.where("vec_id < 90")), 8, 16, rows=100).save(f"file://{tmp_path}/index")
    index = shards.load(spark.newSession(), f"file://{tmp_path}/index")
    for lo, hi in ((90, 98), (98, 300)):  # into the shard that is there, then into new ones
        index = index.add(G.doubled(b.where(f"vec_id >= {lo} and vec_id < {hi}")))
    assert sorted(r[0] for r in index.nodes.groupBy("shard").count().select("count").collect()) and len(index.shards[0]) == 4
    assert index.nodes.count() == index.nodes.select("vec_id").distinct().count() == 300
    f = ShardSearcher(index, b)
    f.set_ef(300)
    assert sorted(map(tuple, f.batch_search(queries(b), 5).collect())) == sorted(map(tuple, knn.exact(queries(b), b, 5).collect()))
    with pytest.raises(ValueError, match="vec_id"):
        index.add(G.doubled(b.where("vec_id = 5")))


@pytest.mark.parametrize("quant", ["SQ1", "PQ8", "SQ6", "FP16"])
def test_codes_in_shards(spark, data, quant):
    b, metric = table(spark, data), "IP" if quant == "SQ1" else "L2"
    f = ShardSearcher(shards.hnsw(G.doubled(b), 8, 16), b, metric, quant)
    f.set_ef(300)
    flat = knn.flat(queries(b), b, 9, f.quantizer)
    assert sorted(map(tuple, f.batch_search(queries(b), 9).collect())) == sorted(map(tuple, flat.collect()))


def test_graphs_built_elsewhere(spark, data):
    b = table(spark, data[:60])
    v = G.doubled(b)
    for g in (B.hnsw(v, 8, 16), G.Graph(B.knn_graph(v, 3), spark.createDataFrame([(7,)], "ep long"))):
        index = shards.of_graph(g, v)
        old = {(r["src"], r["dst"]) for r in g.edges.collect()}
        new = {(r["src"], r["dst"]) for r in index.edges().collect()}
        assert g.upper is None or old == new
        f, rounds = ShardSearcher(index, b), Searcher(g, b)
        for s in (f, rounds):
            s.set_ef(60)
        truth = sorted(map(tuple, knn.exact(queries(b), b, 5).collect()))
        assert sorted(map(tuple, f.batch_search(queries(b), 5).collect())) == truth
        assert g.upper is None or sorted(map(tuple, rounds.batch_search(queries(b), 5).collect())) == truth


def test_quick_benchmark_keeps_its_shards(spark, data, tmp_path):
    b = table(spark, data)
    config = {"R": 8, "L": 20, "efs": [10, 60], "runs": 1, "k": 5}
    one = Benchmark(config, f"file://{tmp_path}/indexes").fit(b)
    two = Benchmark(config, f"file://{tmp_path}/indexes").fit(b)
    assert one.seconds and two.seconds is None
    rows = {r["ef"]: r for r in one.sweep(queries(b), knn.exact(queries(b), b, 5)).collect()}
    again = {r["ef"]: r for r in two.sweep(queries(b), knn.exact(queries(b), b, 5)).collect()}
    assert rows[60]["recall"] >= 0.8 and rows[60]["dist_cmps"] >= rows[10]["dist_cmps"] > 5 and rows[10]["build_seconds"] > 0
    assert {k: (r["recall"], r["dist_cmps"]) for k, r in rows.items()} == {k: (r["recall"], r["dist_cmps"]) for k, r in again.items()}


def test_empty_base(spark, data):
    b = table(spark, data[:10])
    index = shards.hnsw(G.doubled(b.where("vec_id < 0")), 8)
    assert index.nodes.count() == 0


# --- whole graphs ----------------------------------------------------------------------------------------------------


def test_a_hub_is_bounded(spark):
    """All nodes lead to node 0: what is ranked and pruned for it is bounded, and chosen before rows move."""
    x = np.concatenate(([[0.0, 0.0]], np.random.default_rng(7).normal(size=(400, 2)) + 5))
    b = G.doubled(table(spark, x))
    e = spark.createDataFrame([(i, 0, float((x[i] ** 2).sum())) for i in range(1, 401)], "src long, dst long, dist double")
    assert "WindowGroupLimit" in G.lists(G.reversed_edges(e), 20)._jdf.queryExecution().toString()
    out = G.linked_back(e, b, 6, scan=20)
    assert out.where("src = 0").count() <= 6 and out.where("src > 0").count() == 400
    near = G.lists(G.reversed_edges(e), 20)
    assert {tuple(r) for r in out.where("src = 0").select("dst", "dist").collect()} == {tuple(r) for r in G.pruned(near, b, 6, 20).select("dst", "dist").collect()}


def test_lost_nodes_search_for_an_edge(spark, monkeypatch):
    monkeypatch.setattr(G, "COMPARED", 0)
    r = np.random.default_rng(8)
    x = np.concatenate((r.normal(size=(80, 4)), r.normal(size=(60, 4)) + 100))
    b = G.doubled(table(spark, x))
    ep = spark.createDataFrame([(0,)], "ep long")
    compared = []
    monkeypatch.setattr(G, "nearest", lambda far, *a, f=G.nearest, **k: compared.append(far.count()) or f(far, *a, **k))
    out = G.grown(B.knn_graph(b, 3), ep, b, 6)
    assert G.reachable(out, ep.withColumnRenamed("ep", "vec_id")).count() == 140 and sum(compared) == 0
    assert out.groupBy("src").count().agg(F.max("count")).first()[0] <= 6
