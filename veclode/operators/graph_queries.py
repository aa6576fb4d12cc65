"""Queries on graphs: (name, function of base, SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.scratch import scratch_dir, written
from . import builders as B
from . import graph as G
from . import knn
from . import searcher as S
from . import shards as H

K, DEGREE = 10, 16


def _q(b: DataFrame) -> DataFrame:
    return b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


def _knn(b: DataFrame, k: int = K) -> DataFrame:
    return written(B.knn_graph(G.doubled(b), k), "knn")


def _exhaustive(b: DataFrame) -> DataFrame:
    """A search as wide as the graph, on a connected graph: the exact answer."""
    v = G.doubled(b)
    ep = written(G.medoid(b).select("ep"), "ep")
    g = G.Graph(written(G.grown(_knn(b), ep, v, 64), "graph"), ep)
    return G.search(g, _q(b), b, K, ef=b.count(), others=True)


def _stored(b: DataFrame) -> DataFrame:
    """The edges of a graph that was saved and loaded."""
    from ..sources import graph_files

    path = f"{scratch_dir(b.sparkSession)}/veclode/graph-{uuid.uuid4().hex}"
    graph_files.save(G.Graph(_knn(b), G.medoid(b).select("ep")), path)
    return graph_files.load(b.sparkSession, path).edges


def _levels(b: DataFrame) -> DataFrame:
    return b.select("vec_id", B.level(F.col("vec_id"), DEGREE // 2).alias("level"))


def _index(kind: str):
    return lambda b: B.Index(kind, R=DEGREE).build(b).edges


def _sharded(b: DataFrame, kind: str, metric: str = "L2", quant: str = "FP32", degree: int = DEGREE, width: int = 64, rows: int = H.ROWS) -> H.ShardedGraph:
    """An index in shards: HNSW by insertion, any other kind built as a whole and laid out."""
    index = B.Index(kind, metric, quant, degree, width)
    v, own = index.vectors(b)
    v = written(v, "codes")
    return H.hnsw(v, degree, width, own, rows) if kind == "HNSW" else H.of_graph(index.build(b), v, own, rows)


def _search(kind: str, quant: str):
    """A search of one pass over the shards. The pool of 32 is the default; every neighbour is re-ranked in full precision."""

    def run(b: DataFrame) -> DataFrame:
        return S.ShardSearcher(_sharded(b, kind), b, "L2", quant, "FP32").batch_search(_q(b), K, others=True)

    return run


#: Rows of a shard where a query wants several shards.
SMALL = 200


def _shards_exhaustive(b: DataFrame) -> DataFrame:
    """Several shards, each walked with a pool as wide as the shard: the exact answer."""
    f = S.ShardSearcher(_sharded(b, "HNSW", rows=SMALL), b)
    f.set_ef(2 * SMALL)
    return f.batch_search(_q(b), K, others=True)


def _shards_added(b: DataFrame) -> DataFrame:
    """Two thirds of the rows built, saved and opened again, the rest added: the exact answer at full width."""
    v = G.doubled(b)
    path = f"{scratch_dir(b.sparkSession)}/veclode/shards-{uuid.uuid4().hex}"
    H.hnsw(v.where("vec_id % 3 > 0"), DEGREE, 32, rows=SMALL).save(path)
    index = H.load(b.sparkSession, path).add(v.where("vec_id % 3 = 0"))
    f = S.ShardSearcher(index, b)
    f.set_ef(b.count())
    return f.batch_search(_q(b), K, others=True)


def _shards_checked(metric: str, quant: str, scaled: bool):
    """What the index in shards promises, like ``*_checked``: on vectors of different lengths the metrics rank differently."""

    def run(b: DataFrame) -> DataFrame:
        if scaled:
            b = b.select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 7 + 1)).alias("embedding"))
        g = _sharded(b, "HNSW", metric, quant)
        found = S.ShardSearcher(g, b, metric, quant, "FP32")
        found.set_ef(WIDE)
        return _promises(b, written(g.edges(), "edges"), g.entries(), knn.recall(found.batch_search(_q(b), K, others=True), knn.exact(_q(b), b, K, metric, others=True), K), DEGREE)

    return run


def _recalls(kind: str, quant: str, efs: tuple[int, ...] = (20, 32, 64, 100)):
    """ef, hits, recall and mean comparisons of searches that are ever wider, without the query itself."""

    def run(b: DataFrame) -> DataFrame:
        f, q = S.ShardSearcher(_sharded(b, kind), b, "L2", quant, "FP32"), _q(b)
        truth, out = written(knn.exact(q, b, K, others=True), "truth"), []
        for ef in efs:
            f.set_ef(ef)
            r = knn.recall(f.batch_search(q, K, others=True), truth, K).first()
            out.append((ef, r["hits"], r["recall"], f.get_last_search_dist_cmps()))
        return b.sparkSession.createDataFrame(out, "ef int, hits long, recall double, dist_cmps double")  # a row a width

    return run


def _quick(b: DataFrame) -> DataFrame:
    """The quick benchmark: built on SQ8U with R = 48 and L = 200, searched by SQ4U, re-ranked in half precision. Each query is a row
    of the base, so one of its ten neighbours is itself. Without the columns that differ from run to run."""
    q = _q(b)
    return S.Benchmark({"runs": 1}).fit(b).sweep(q, written(knn.exact(q, b, K), "truth")).select("ef", "recall", "dist_cmps")


def _compared_with_all(b: DataFrame) -> DataFrame:
    """Comparisons of a search as wide as a connected graph: every node, once."""
    v, ep = G.doubled(b), written(G.medoid(b).select("ep"), "ep")
    g = G.Graph(written(G.grown(_knn(b), ep, v, 64), "graph"), ep)
    return G.comparisons(g, _q(b), b, ef=b.count())


def _nn_recall(b: DataFrame) -> DataFrame:
    """Share of the true 10 nearest of every 20th row that NN-Descent's graph holds."""
    e = B.nn_descent(G.doubled(b), K).where("src % 20 = 0").select(F.col("src").alias("q_id"), (F.col("pos") + 1).alias("rank"), F.col("dst").alias("vec_id"))
    return knn.recall(e, knn.exact(_q(b), b, K, others=True), K)


def _progress(b: DataFrame) -> DataFrame:
    """Recall of every round of NN-Descent on every 20th row or so, the random start included."""
    v = G.doubled(b)
    p = B.Progress(v, K, nodes=max(1, b.count() // 20))
    B.nn_descent(v, K, progress=p)
    return p.rows(b.sparkSession)


#: Largest degree of each index with R = DEGREE, and recall that a search with a pool of WIDE must reach.
CAPS, WIDE, RECALL = {"NSG": DEGREE, "SSG": DEGREE, "HNSW": DEGREE, "RNNDESCENT": DEGREE}, 64, 0.9


def _checked(kind: str, metric: str = "L2", quant: str = "SQ8U"):
    """One row that states what an index promises: every node has edges within the cap to others, none twice, in ascending
    order; all nodes are reached (RNNDESCENT doesn't promise that); searches find at least RECALL of the neighbours."""

    def run(b: DataFrame) -> DataFrame:
        g = B.Index(kind, metric, quant, R=DEGREE, L=WIDE).build(b)
        found = S.Searcher(g, b, metric, quant, "FP32")
        found.set_ef(WIDE)
        share = knn.recall(found.batch_search(_q(b), K, others=True), knn.exact(_q(b), b, K, metric, others=True), K)
        return _promises(b, g.edges, g.entries, share, CAPS[kind], kind != "RNNDESCENT")

    return run


def _promises(b: DataFrame, e: DataFrame, entries: DataFrame, share: DataFrame, cap: int, all_reached: bool = True) -> DataFrame:
    edges = e.agg((F.max(F.col("pos") + 1) <= cap).alias("within_cap"), (F.count(F.lit(1)) == F.countDistinct("src", "dst")).alias("no_edge_twice"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("loops"))
    lost = b.select("vec_id").join(G.reachable(e, entries.select(F.col("ep").alias("vec_id"))), "vec_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    nodes = b.agg(F.count(F.lit(1)).alias("nodes"))
    row = nodes.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(share))
    return row.select("nodes", "within_cap", "no_edge_twice", (F.col("loops") == 0).alias("no_loop"), ((F.col("lost") == 0) | F.lit(not all_reached)).alias("all_reached"), "n_queries", (F.col("recall") >= RECALL).alias("recall_reached"))


CHECKED = "SELECT count(*) AS nodes, TRUE AS within_cap, TRUE AS no_edge_twice, TRUE AS no_loop, TRUE AS all_reached, count(*) FILTER (vec_id % 20 = 0) AS n_queries, TRUE AS recall_reached FROM embeddings"


def _nn_reached(b: DataFrame) -> DataFrame:
    return _nn_recall(b).select("n_queries", (F.col("recall") >= RECALL).alias("recall_reached"))


def _linked(b: DataFrame) -> DataFrame:
    """Nearest-neighbour lists with reverse edges, where no node comes to the cap: nothing is pruned."""
    return G.linked_back(_knn(b, 3), G.doubled(b), 10_000).select("src", "pos", "dst", "dist")


def _comparisons(b: DataFrame) -> DataFrame:
    ep = written(G.medoid(b).select("ep"), "ep")
    return G.comparisons(G.Graph(_knn(b), ep), _q(b), b, ef=32)


def _linked_pruned(b: DataFrame) -> DataFrame:
    """Lists of eight with reverse edges: most nodes have more than eight then, and are pruned."""
    return G.linked_back(_knn(b, 8), G.doubled(b), 8).select("src", "pos", "dst", "dist")


def _pruned(b: DataFrame) -> DataFrame:
    return G.pruned(_knn(b, 32), G.doubled(b), DEGREE, 32)


E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _near(k: int) -> str:
    return f"""g AS (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {_l2('a.v', 'b.v')} AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id)
QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= {k})"""


MEDOID = f"""grid AS (SELECT pow(2.0::DOUBLE, 61 - ceil(log2(max(list_max(list_transform(v, lambda x: abs(x)))))) - ceil(log2(count(*)))) AS u FROM e),
m AS (SELECT list(x ORDER BY p) AS c FROM (SELECT p, sum(floor(v[p] * u + 0.5)::BIGINT)::DOUBLE / any_value(u) / count(*)::DOUBLE AS x FROM (SELECT v, u, unnest(range(1, len(v) + 1)) AS p FROM e, grid) GROUP BY p)),
d AS (SELECT vec_id AS ep, {_l2('v', 'c')} AS dist FROM e, m), ep AS (SELECT ep, dist FROM d ORDER BY dist, ep LIMIT 1)"""


def _occlusion_sql(candidates: str = "", cap: int = DEGREE) -> str:
    """The greedy rule as a recursion over candidates in ascending order: kept ones are carried as a list. candidates: CTEs up to
    c(src, dst, dist); nearest-neighbour lists of 32 by default."""
    return f"""WITH RECURSIVE {E}, {candidates or _near(32) + ', c AS (SELECT * FROM g)'}, o AS (SELECT src, dst, dist, v, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS n FROM c JOIN e ON e.vec_id = c.dst),
r AS (SELECT src, 1 AS n, [dst] AS kept, [dist] AS dists, [v] AS vs FROM o WHERE n = 1
UNION ALL SELECT r.src, o.n, CASE WHEN ok THEN list_append(kept, o.dst) ELSE kept END, CASE WHEN ok THEN list_append(dists, o.dist) ELSE dists END, CASE WHEN ok THEN list_append(vs, o.v) ELSE vs END
FROM (SELECT r.*, o.dst AS odst, len(r.kept) < {cap} AND NOT list_bool_or(list_transform(r.vs, lambda w: {_l2('w', 'o.v')} < o.dist)) AS ok FROM r JOIN o ON o.src = r.src AND o.n = r.n + 1) r JOIN o ON o.src = r.src AND o.n = r.n + 1)
SELECT src, (i - 1)::INT AS pos, kept[i] AS dst, dists[i] AS dist FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC) = 1))"""


def _linked_sql() -> str:
    """Nodes with more than eight go through the greedy rule, the others keep all."""
    ctes = f"{_near(8)}, u AS (SELECT src, dst, dist FROM g UNION SELECT dst, src, dist FROM g), w AS (SELECT *, count(*) OVER (PARTITION BY src) AS m FROM u), c AS (SELECT src, dst, dist FROM w WHERE m > 8)"
    return _occlusion_sql(ctes, 8) + " UNION ALL SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS pos, dst, dist FROM w WHERE m <= 8"


#: Exact neighbours of every 20th row.
NEIGHBOURS = f"WITH {E}, {_near(K)} SELECT src AS q_id, (row_number() OVER (PARTITION BY src ORDER BY dist, dst))::INT AS rank, dst AS vec_id, dist FROM g WHERE src % 20 = 0"


def entries():
    return [
        ("knn_graph", _knn, f"WITH {E}, {_near(K)} SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS pos, dst, dist FROM g"),
        ("graph_stored", _stored, f"WITH {E}, {_near(K)} SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS pos, dst, dist FROM g"),
        ("reverse_edges", lambda b: G.lists(G.reversed_edges(_knn(b)), 5), f"WITH {E}, {_near(K)}, r AS (SELECT dst AS src, (row_number() OVER (PARTITION BY dst ORDER BY dist, src) - 1)::INT AS pos, src AS dst, dist FROM g) SELECT * FROM r WHERE pos < 5"),
        ("degree_stats", lambda b: G.degree_statistics(G.reversed_edges(_knn(b)), b), f"WITH {E}, {_near(K)}, n AS (SELECT e.vec_id, count(g.src) AS n FROM e LEFT JOIN g ON g.dst = e.vec_id GROUP BY 1) SELECT min(n) AS min_degree, max(n) AS max_degree, avg(n) AS avg_degree FROM n"),
        ("medoid", G.medoid, f"WITH {E}, {MEDOID} SELECT ep, dist FROM ep"),
        ("reachable", lambda b: G.reachable(_knn(b, 3), G.medoid(b).select(F.col("ep").alias("vec_id"))), f"WITH RECURSIVE {E}, {_near(3)}, {MEDOID}, s AS (SELECT ep AS vec_id FROM ep UNION SELECT g.dst FROM s JOIN g ON g.src = s.vec_id) SELECT vec_id FROM s"),
        ("beam_exhaustive", _exhaustive, NEIGHBOURS),
        ("hnsw_levels", _levels, f"SELECT vec_id, floor(-ln((('0x' || substr(md5(vec_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 1) / {2**48}.0) / ln({DEGREE // 2}))::INT AS level FROM embeddings"),
        ("prune_occluded", _pruned, _occlusion_sql()),
        ("linked_back", _linked, f"WITH {E}, {_near(3)}, u AS (SELECT src, dst, dist FROM g UNION SELECT dst, src, dist FROM g) SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS pos, dst, dist FROM u"),
        ("linked_back_pruned", _linked_pruned, _linked_sql()),
        ("dist_cmps", _comparisons, None),
        ("dist_cmps_exhaustive", _compared_with_all, "SELECT vec_id AS q_id, (SELECT count(*) FROM embeddings) AS dist_cmps FROM embeddings WHERE vec_id % 20 = 0"),
        ("shards_exhaustive", _shards_exhaustive, NEIGHBOURS),
        ("shards_added", _shards_added, NEIGHBOURS),
        ("shards_hnsw_checked", _shards_checked("L2", "SQ8U", False), CHECKED),
        ("shards_hnsw_ip_checked", _shards_checked("IP", "FP16", True), CHECKED),
        ("shards_hnsw_recall", _recalls("HNSW", "SQ8U"), None),
        ("shards_nsg_recall", _recalls("NSG", "SQ8U"), None),
        ("quick_sweep", _quick, None),
        ("nndescent_build", lambda b: B.nn_descent(G.doubled(b), K), None),
        ("nndescent_recall", _nn_recall, None),
        ("nndescent_progress", _progress, None),
        ("nndescent_checked", _nn_reached, "SELECT count(*) AS n_queries, TRUE AS recall_reached FROM embeddings WHERE vec_id % 20 = 0"),
        ("rnndescent_build", lambda b: B.rnn_descent(G.doubled(b), DEGREE).edges, None),
        ("nsg_build", _index("NSG"), None),
        ("ssg_build", _index("SSG"), None),
        ("hnsw_build", _index("HNSW"), None),
        ("search_hnsw_sq4u", _search("HNSW", "SQ4U"), None),
        ("search_nsg_sq8u", _search("NSG", "SQ8U"), None),
        ("nsg_checked", _checked("NSG"), CHECKED),
        ("ssg_checked", _checked("SSG"), CHECKED),
        ("hnsw_checked", _checked("HNSW"), CHECKED),
        ("hnsw_ip_checked", _checked("HNSW", "IP", "FP16"), CHECKED),
        ("rnndescent_checked", _checked("RNNDESCENT"), CHECKED),
    ]
