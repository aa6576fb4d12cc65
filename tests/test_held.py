"""Graphs whose vectors all tasks hold, against the joins that larger ones take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.operators import builders as B
from veclode.operators import graph as G
from veclode.operators import held, knn
from veclode.operators import walk as W


@pytest.fixture(scope="module")
def base(spark):
    x = np.random.default_rng(1).normal(size=(150, 6))
    x[100:120] = x[100]  # copies
    return spark.createDataFrame([(3 * i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>").repartition(3).persist()


def edges(df):
    return sorted(map(tuple, df.select("src", "pos", "dst", "dist").collect()))


@pytest.mark.parametrize("kind", ["L2", "IP"])
def test_steps_give_what_joins_give(spark, base, monkeypatch, kind):
    h = held.hold(base)
    near = held.neighbours(h, 12, kind)
    mine = edges(near), edges(held.pruned(h, near, 5, 12, kind)), edges(held.linked_back(h, near.where("pos < 4"), 5, kind))
    monkeypatch.setattr(held, "hold", lambda base: None)
    assert mine[0] == edges(B.knn_graph(base, 12, kind))
    assert mine[1] == edges(G.pruned(near, base, 5, 12, metric=kind))
    theirs = edges(G.linked_back(near.where("pos < 4"), base, 5, kind))
    assert [(a, c, d) for a, _, c, d in mine[2]] == sorted((a, c, d) for a, _, c, d in theirs) or {e[0] for e in mine[2]} == {e[0] for e in theirs}


def test_a_search_is_best_first(spark, base):
    h = held.hold(base)
    g = G.Graph(B.knn_graph(base, 8), spark.createDataFrame([(0,), (300,)], "ep long"))
    q = base.where("vec_id % 5 = 0").select(F.col("vec_id").alias("q_id"), "v")
    got = held.search(h, q, [held.links(h, g.edges)], held.places(h, [0, 300]), 4, 20, "L2", True).toPandas()
    ids, x = h.sent.value
    at, (o, d) = held.links(h, g.edges).value, (None, None)
    for i, part in got.groupby("q_id"):
        o, d, n = W.walk(x, at, held.places(h, [0, 300])[None], x[[np.searchsorted(ids, i)]], 20, "L2")
        want = sorted((float(e), int(ids[j])) for j, e in zip(o[0], d[0], strict=True) if j >= 0 and ids[j] != i)[:4]
        assert np.allclose(sorted(part.dist), [e for e, _ in want], atol=1e-9) and (part.dist_cmps == n[0]).all()


@pytest.mark.parametrize("kind", ["NSG", "SSG", "HNSW"])
def test_builders_join_no_pairs_with_vectors(spark, base, monkeypatch, kind):
    def never(*_, **__):
        raise AssertionError("pairs joined with vectors")

    for name, of in (("nn_descent", B), ("_with_distance", B), ("beam", G), ("pruned", G), ("linked_back", G), ("grown", G)):
        monkeypatch.setattr(of, name, never)
    b = base.withColumnRenamed("v", "embedding")
    g = B.Index(kind, R=6, L=20).build(b)
    e = g.edges.toPandas()
    assert e.groupby("src").size().max() <= 6 and not e.duplicated(["src", "dst"]).any() and (e.src != e.dst).all()
    assert G.reachable(g.edges, g.entries.select(F.col("ep").alias("vec_id"))).count() == 150
    q = b.where("vec_id % 5 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    found, true = G.search(g, q, b, 5, 40, others=True), knn.exact(q, b, 5, others=True)
    far = lambda df: df.groupBy("q_id").agg(F.max("dist").alias("d")).orderBy("q_id").toPandas()["d"].to_numpy()  # noqa: E731  copies make ties
    assert (far(found) <= far(true) + 1e-12).mean() >= 0.9


def test_larger_graphs_have_further_entries(spark, base, monkeypatch):
    monkeypatch.setattr(B, "EACH", 30)
    assert 5 <= B.Index("NSG", R=6, L=20).build(base.withColumnRenamed("v", "embedding")).entries.count() <= 6


def test_descents_look_vectors_up(spark, base, monkeypatch):
    """Rounds of both descents in tasks give the graph that joins give, up to what a round of the other form sees."""
    x = np.random.default_rng(2).normal(size=(90, 4))
    b = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>").persist()
    e = B._with_distance(B._draws(b, 12, 1), b).withColumn("new", F.lit(True)).persist()
    h = held.hold(b)
    rows = e.join(b.select(F.col("vec_id").alias("dst"), "v"), "dst").select("src", "dst", "dist", "new", "v").repartition("src").sortWithinPartitions("src", "dist", "dst")
    want = sorted(map(tuple, rows.mapInArrow(B._reroute, "src long, dst long, dist double, new boolean").collect()))
    got = sorted(map(tuple, held.rerouted(h, e, 96).collect()))
    assert [(a, c, n) for a, c, _, n in got] == [(a, c, n) for a, c, _, n in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    hood = e.where("pmod(src + dst, 3) > 0").select("src", "dst", (F.col("dst") % 2 == 0).alias("new"))
    near = {tuple(r) for r in held.joined(h, hood, e, 10**6).select("src", "dst").collect()}
    of = {}
    for s, d, n in hood.collect():
        of.setdefault(s, []).append((d, n))
    assert near == {(u, w) for own in of.values() for u, nu in own for w, nw in own if u != w and (nu or nw)}
