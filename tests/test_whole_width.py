"""Searches as wide as what they search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veclode.operators import builders as B
from veclode.operators import graph as G
from veclode.operators import knn, shards
from veclode.operators import walk as W
from veclode.operators.searcher import ShardSearcher


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def queries(b):
    return b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


def rows(df):
    return sorted(map(tuple, df.select("q_id", "rank", "vec_id", "dist").collect()))


def never(*_, **__):
    raise AssertionError("rows of a pool as wide as the graph")


def test_pool_as_wide_as_a_graph_is_not_kept_as_rows(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(120, 5))
    x[100:] += 1e3  # an island of 20 that the entry doesn't reach
    b = table(spark, x)
    near = B.knn_graph(G.doubled(b), 4).where("(src < 100) = (dst < 100)")
    g = G.Graph(near, spark.createDataFrame([(0,)], "ep long"))
    reached = {r["vec_id"] for r in G.reachable(near, g.entries.withColumnRenamed("ep", "vec_id")).collect()}
    assert reached and max(reached) < 100
    q, inner = queries(b), b.where(F.col("vec_id").isin(sorted(reached)))
    at = q.select("q_id", F.lit(0).cast("long").alias("vec_id"))
    v = q.select("q_id", F.col("embedding").alias("v"))
    pool = G.beam(v, G.doubled(b), near, at, 120)
    walked = knn.ranked(pool.pool.where("q_id <> vec_id"), 5)
    monkeypatch.setattr(G, "beam", never)
    got = rows(G.search(g, q, b, 5, ef=120, others=True))
    assert got == rows(walked) == rows(knn.exact(q, inner, 5, others=True))
    assert {tuple(r) for r in G.comparisons(g, q, b, 120).collect()} == {(i, len(reached)) for i in range(0, 120, 20)}


def test_pool_as_wide_as_a_shard_compares_in_blocks():
    x = np.repeat(np.random.default_rng(2).normal(size=(60, 5)), 2, axis=0)  # every vector twice, so ranks have ties
    own = np.zeros(120, int)
    own[:4] = 1
    s = W.inserted(W.Shard(x), own, 4, 24, "L2")
    ids = np.arange(120)[::-1].copy()
    links, upper = shards._columns(s, own)
    t = pa.table({"node": pa.array(np.arange(120), pa.int32()), "vec_id": ids, "level": pa.array(own, pa.int32()), "code": list(x), "links": links, "upper": upper})

    class Sent:
        value = np.array([3, 50]), x[[116, 69]], None, {}

    wide = shards._walked(Sent, lambda c: np.array(c.to_pylist()), 500, 7, "L2", True)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(W, "walk", lambda *a: never() if a[4] > 1 else (a[2], None, np.zeros(len(a[3]), int)))
        got = wide([pa.scalar(0)], t).to_pandas()
    d = {i: ((x[119 - i] - x) ** 2).sum(axis=1) for i in (3, 50)}
    for i in d:
        want = sorted((d[i][119 - j], j) for j in range(120) if j != i)[:7]
        assert [j for _, j in want] == got[got.q_id == i].sort_values(["dist", "vec_id"]).vec_id.tolist() and (got.dist_cmps == 120).all()


def test_shards_narrower_than_the_pool(spark):
    x = np.random.default_rng(3).normal(size=(300, 6))
    b = table(spark, x)
    f = ShardSearcher(shards.hnsw(G.doubled(b), 8, 16, rows=100), b)
    f.set_ef(300)
    assert rows(f.batch_search(queries(b), 5, others=True)) == rows(knn.exact(queries(b), b, 5, others=True))
    assert f.get_last_search_dist_cmps() >= 300


def test_finished_shards_are_searched_anew():
    """Nodes that were inserted early don't keep what they found among few: lists fill up, and searches find more."""
    x = np.random.default_rng(6).normal(size=(2000, 32))
    own = np.floor(-np.log(np.random.default_rng(7).random(2000)) / np.log(8)).astype(int)
    s = W.inserted(W.Shard(x), own, 8, 48, "L2")
    q = x[::20]
    true = np.argsort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :11]
    found = W.search(s, q, 32, "L2")[0]
    share = np.mean([len({*a[:11]} & {*b}) for a, b in zip(found, true, strict=True)]) / 11
    assert share >= 0.97 and (s.links[0] >= 0).sum(axis=1).mean() > 11
    assert W.reached(s.links[0], s.entry).all() and s.links[0].shape[1] == 16
