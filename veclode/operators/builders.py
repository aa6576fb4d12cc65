"""Index builders: kNN graph, NN-Descent, RNN-Descent, NSG and SSG, HNSW, as loops of joins, windows and one grouped
pruning step. Choices that the literature leaves to a random generator are made by a hash of ids."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..plans.scratch import written
from . import graph as G
from . import held, knn
from . import quantizers as Q

INDEXES = ("HNSW", "NSG", "SSG", "RNNDESCENT")


def knn_graph(base: DataFrame, k: int, metric: str = "L2") -> DataFrame:
    """Exact: src, pos, dst, dist of the k nearest others; base: (vec_id, v). It compares all with all, block by block; large
    data take :func:`nn_descent`."""
    if (h := held.hold(base)) is not None:
        return held.neighbours(h, k, metric)
    found = knn.nearest(base.select(F.col("vec_id").alias("q_id"), "v"), base, k, metric, others=True)
    return found.select(F.col("q_id").alias("src"), (F.col("rank") - 1).alias("pos"), F.col("vec_id").alias("dst"), "dist")


def _draws(base: DataFrame, n: int, seed: int) -> DataFrame:
    """(src, dst): n pseudo-random others of each node.

    Nodes are numbered in the order of their hash within hash ranges, and a node is joined with the n next numbers of
    a range drawn by hash, so no node is compared with all.
    """
    rows = base.count()
    parts = max(1, rows // 4096)
    h = lambda c, s: F.pmod(F.xxhash64(c, F.lit(seed * 31 + s)), F.lit(2**31))
    at = base.select("vec_id", F.pmod(h("vec_id", 0), F.lit(parts)).alias("part"))
    at = at.withColumn("nr", F.row_number().over(Window.partitionBy("part").orderBy(h("vec_id", 1), "vec_id")) - 1)
    at = written(at.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("part"))), "numbers")
    asks = base.select(F.col("vec_id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("t"))
    asks = asks.withColumn("part", F.pmod(F.xxhash64("src", "t", F.lit(seed)), F.lit(parts)))
    sizes = at.select("part", "size").distinct()
    asks = asks.join(sizes, "part").withColumn("nr", F.pmod(F.xxhash64("src", "t", F.lit(seed + 1)), F.col("size")).cast("int"))
    return asks.join(at.select("part", "nr", F.col("vec_id").alias("dst")), ["part", "nr"]).where("src <> dst").select("src", "dst").distinct()


def _with_distance(pairs: DataFrame, base: DataFrame, metric: str = "L2", h: held.Held | None = None) -> DataFrame:
    if h:
        return held.with_distance(h, pairs, metric)
    p = pairs.join(base.select(F.col("vec_id").alias("src"), F.col("v").alias("_a")), "src").join(base.select(F.col("vec_id").alias("dst"), F.col("v").alias("_b")), "dst")
    return p.withColumn("dist", V.metric(metric)(F.col("_a"), F.col("_b"))).drop("_a", "_b")


class Progress:
    """Recall of NN-Descent by round, on a sample of nodes that is drawn by hash and whose true neighbours are found once.

    ``gain``: a round that adds less than this share of the sample's neighbours is the last one; without it rounds go on until
    nothing changes.
    """

    def __init__(self, base: DataFrame, k: int, metric: str = "L2", nodes: int = 100, gain: float | None = None, seed: int = 1) -> None:
        self.k, self.gain, self.recalls = k, gain, []
        first = base.select(F.col("vec_id").alias("q_id"), "v").orderBy(F.xxhash64("q_id", F.lit(seed)), "q_id").limit(nodes)
        self.truth = written(knn.nearest(written(first, "sample"), base, k, metric, others=True).select("q_id", "vec_id"), "truth")
        self.size = max(self.truth.count(), 1)

    def add(self, pool: DataFrame) -> bool:
        """Note the recall of a round's pool (src, dst, dist); whether rounds should go on."""
        own = G.lists(pool.join(self.truth.select(F.col("q_id").alias("src")).distinct(), "src", "left_semi"), self.k)
        hits = own.join(self.truth, (F.col("src") == F.col("q_id")) & (F.col("dst") == F.col("vec_id"))).count()
        self.recalls.append(hits / self.size)
        return self.gain is None or len(self.recalls) < 2 or self.recalls[-1] - self.recalls[-2] >= self.gain

    def rows(self, spark) -> DataFrame:
        """(round, recall), a row a round; round 0 is the random start."""
        return spark.createDataFrame(list(enumerate(self.recalls)), "round int, recall double")


def nn_descent(base: DataFrame, k: int, sample: int = 10, pool: int | None = None, iterations: int | None = None, seed: int = 1, metric: str = "L2", progress: Progress | None = None) -> DataFrame:
    """Approximate kNN graph: neighbours of a common neighbour are compared with each other, new ones with all.

    Every node keeps its ``pool`` (k + 50) nearest; per round it offers up to ``sample`` new and old ones, and as many
    that point to it, so a round compares at most (2 * sample) ** 2 pairs a node whatever the degrees. Rounds go on until no
    node's list changes, then once more with all rows as new ones, whose samples of what points to a node are other
    ones; or for ``iterations``. progress: notes each round's recall, and may end the rounds.
    """
    pool = pool or k + 50
    best = Window.partitionBy("src").orderBy("dist", "dst")

    def top(e: DataFrame) -> DataFrame:
        e = e.where("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
        return written(e.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool).drop("r"), "pool")

    h, again = held.hold(base), False
    e = top(_with_distance(_draws(base, sample, seed), base, metric, h).withColumn("new", F.lit(True)))
    for t in itertools.count() if iterations is None else range(iterations):
        if progress is not None and not progress.add(e):
            break
        offer = e.withColumn("r", F.row_number().over(Window.partitionBy("src", "new").orderBy("dist", "dst"))).where(F.col("r") <= sample).drop("r")
        offer = written(offer, "offer")
        back = offer.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "new")
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("src", "new").orderBy(F.xxhash64("dst", F.lit(seed + t)), "dst"))).where(F.col("r") <= sample).drop("r")
        hood = written(offer.unionByName(back).groupBy("src", "dst").agg(F.max("new").alias("new")), "hood")
        if h:
            got = held.joined(h, hood, e, pool, metric).withColumn("new", F.lit(True))
        else:
            a, b = hood.select("src", F.col("dst").alias("u"), F.col("new").alias("nu")), hood.select("src", F.col("dst").alias("w"), F.col("new").alias("nw"))
            pairs = a.join(b, "src").where("u < w and (nu or nw)").select(F.col("u").alias("src"), F.col("w").alias("dst")).distinct()
            got = _with_distance(pairs, base, metric)
            got = got.unionByName(got.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).withColumn("new", F.lit(True))
        offered = offer.select("src", "dst", F.lit(True).alias("o"))
        kept = e.join(offered, ["src", "dst"], "left").withColumn("new", F.col("new") & F.col("o").isNull()).drop("o")
        e = top(kept.unionByName(got.select("src", "dst", "dist", "new")))
        if not e.where("new").limit(1).count():
            if again:
                break
            again, e = True, e.withColumn("new", F.lit(True))
    if progress is not None:
        progress.add(e)
    return G.lists(e, k)


def _reroute(batches):
    """Of a node's neighbours, nearest first: keep what no kept one hides; send a hidden one to the one that hides it."""
    import pyarrow as pa

    for src, dst, dist, new, v in G.groups(batches, "src", ("dst", "dist", "new", "v")):
        kept: list[int] = []
        out: list[tuple[int, int, float, bool]] = []
        for i in range(len(dst)):
            if kept:
                d = ((v[kept] - v[i]) ** 2).sum(axis=1)
                hide = np.flatnonzero((d < dist[i]) & (new[kept] | new[i]))
                if len(hide):
                    out.append((int(dst[kept[hide[0]]]), int(dst[i]), float(d[hide[0]]), True))
                    continue
            kept.append(i)
        out += [(int(src[0]), int(dst[i]), float(dist[i]), False) for i in kept]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["src", "dst", "dist", "new"])


def rnn_descent(base: DataFrame, degree: int, outer: int = 4, inner: int = 15, start: int = 20, cap: int = 96, seed: int = 1) -> G.Graph:
    """Relative-neighbour descent: rounds of hiding and rerouting, with reverse edges between outer rounds."""

    def merged(e: DataFrame, limit: int) -> DataFrame:
        e = e.where("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("new").alias("new"))
        return e.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("r") <= limit).drop("r")

    h = held.hold(base)
    e = written(merged(_with_distance(_draws(base, start, seed), base, h=h).withColumn("new", F.lit(True)), cap), "edges")
    for t in range(outer):
        for _ in range(inner):
            if h:  # merged by the round that reads it
                e = written(held.rerouted(h, e, cap), "edges")
                if not e.where("new").limit(1).count():
                    break
                continue
            rows = e.join(base.select(F.col("vec_id").alias("dst"), "v"), "dst").select("src", "dst", "dist", "new", "v")
            rows = rows.repartition("src").sortWithinPartitions("src", "dist", "dst")
            e = written(merged(rows.mapInArrow(_reroute, "src long, dst long, dist double, new boolean"), cap), "edges")
            if not e.where("new").limit(1).count():
                break
        if t < outer - 1:  # forward edges count as new again, reversed copies keep their mark
            back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "new")
            e = written(merged(e.withColumn("new", F.lit(True)).unionByName(back), cap), "edges")
    ep = base.select(F.min(F.struct(F.xxhash64("vec_id", F.lit(seed)).alias("h"), "vec_id")).alias("x")).select(F.col("x.vec_id").alias("ep")).where("ep is not null")
    return G.Graph(written(G.lists(e, degree), "graph"), _further(base, written(ep, "entries")))


#: Nodes for each of which a graph has a further entry, and further entries at most.
EACH, FURTHER = 4096, 64


def _further(base: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries, and a node drawn by hash for every EACH: where searches start in one region only, as at the medoid, a dense
    group there can fill their pools."""
    n = min(base.count() // EACH, FURTHER)
    drawn = base.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(n).select(F.col("vec_id").alias("ep"))
    return written(entries.unionByName(drawn).distinct(), "entries") if n else entries


def _all_reached(h: held.Held | None, edges: DataFrame, entries: DataFrame, base: DataFrame, cap: int, metric: str = "L2") -> DataFrame:
    """Edges by which every node is reached from the one entry, found in a task that holds the graph, or by rounds."""
    e = held.grown(h, edges, entries.first()["ep"], cap, metric) if h else None
    return e if e is not None else G.grown(edges, entries, base, cap, metric)


def nsg(base: DataFrame, degree: int, pool: int | None = None, angle: bool = False, neighbours: DataFrame | None = None, k: int = 64) -> G.Graph:
    """Navigating spreading-out graph, or (angle) the one that spreads by angles of 60 degrees.

    kNN graph -> medoid -> for every node a search from the medoid, whose looked-at nodes and its kNN are candidates ->
    pruning -> reverse edges (pruned by distance under either rule) -> edges until all is reached.
    base: (vec_id, v); neighbours: a kNN graph. By default it is exact where tasks can hold the vectors, which then also search and
    prune (:mod:`held`), and NN-Descent's where they can't.
    """
    pool = pool or degree + 32
    h = held.hold(base)
    near = written(neighbours if neighbours is not None else held.neighbours(h, k) if h else nn_descent(base, k), "knn")
    entries = written(G.medoid(base.select("vec_id", F.col("v").alias("embedding"))).select("ep"), "entries")
    if h and (lists := held.links(h, near)) is not None:
        ep = entries.first()["ep"]
        e = written(held.spread_out(h, lists, held.places(h, [ep]), degree, pool, degree + 100, angle), "pruned")
        e = written(held.linked_back(h, e, degree), "linked")
        return G.Graph(written(_all_reached(h, e, entries, base, degree), "graph"), _further(base, entries))
    q = base.select(F.col("vec_id").alias("q_id"), "v")
    seen = G.beam(q, base, near, q.select("q_id").crossJoin(F.broadcast(entries.select(F.col("ep").alias("vec_id")))), pool, seen=True).seen
    candidates = seen.select(F.col("q_id").alias("src"), F.col("vec_id").alias("dst"), "dist").unionByName(near.select("src", "dst", "dist"))
    e = written(G.pruned(candidates, base, degree, degree + 100, angle), "pruned")
    e = written(G.linked_back(e, base, degree), "linked")
    return G.Graph(written(G.grown(e, entries, base, degree), "graph"), _further(base, entries))


def level(vec_id: Column, m: int) -> Column:
    """The highest layer of a node: floor(-ln u / ln m), u from 48 bits of a hash of its id, whatever id that is."""
    u = (F.conv(F.substring(F.md5(vec_id.cast("string").cast("binary")), 1, 12), 16, 10).cast("double") + 1) / float(2**48)
    return F.floor(-F.log(u) / F.lit(math.log(m))).cast("int")


def hnsw(base: DataFrame, degree: int, width: int = 0, metric: str = "L2") -> G.Graph:
    """Hierarchical small world, built a layer at a time rather than a node at a time.

    A layer's nodes are those of its level or above; each takes candidates from its ``width`` nearest in the layer (exact where
    tasks can hold its vectors, else by NN-Descent), prunes them, and links back. Layers above hold degree / 2 edges a node, the ground layer degree. The entry is
    the lowest id of the top layer. Distances are the metric's in every step.
    """
    m = max(degree // 2, 2)
    width = max(width, m)
    at = written(base.withColumn("level", level(F.col("vec_id"), m)), "levels")
    top = at.agg(F.max("level")).first()[0] or 0
    ground, upper = None, None
    for n in range(top, -1, -1):
        own = written(at.where(F.col("level") >= n).select("vec_id", "v"), "own")
        cap = m if n else 2 * m
        h = held.hold(own)
        if h:
            e = written(held.pruned(h, held.neighbours(h, width, metric), cap, width, metric), "pruned")
            e = written(held.linked_back(h, e, cap, metric), "layer")
        else:
            near = nn_descent(own, width, metric=metric)
            e = written(G.linked_back(written(G.pruned(near, own, cap, width, metric=metric), "pruned"), own, cap, metric), "layer")
        if n:
            part = e.withColumn("layer", F.lit(n))
            upper = part if upper is None else upper.unionByName(part)
        else:
            ground = e
    entry = written(at.where(F.col("level") == top).agg(F.min("vec_id").alias("ep")).where("ep is not null"), "entries")
    # nodes that no edge reaches from the entry in the ground layer would be lost
    return G.Graph(written(_all_reached(held.hold(base), ground, entry, base, 2 * m, metric), "graph"), entry, upper)


class Index:
    """Builder by name: HNSW, NSG, SSG or RNNDESCENT. quant: vectors are replaced by their codes' before building.

    HNSW builds on the metric; NSG, SSG and RNNDESCENT are defined on squared L2 and always build on it.
    """

    def __init__(self, index_type: str, metric: str = "L2", quant: str = "FP32", R: int = 32, L: int = 0) -> None:
        self.kind = index_type.upper()
        if self.kind not in INDEXES:
            raise ValueError(f"unknown index {index_type!r}; known: {', '.join(INDEXES)}")
        V.metric(metric)
        self.metric, self.quant, self.R, self.L, self.seconds = metric.upper(), Q.known(quant), R, L, None
        if self.quant not in Q.SYMMETRIC:
            raise ValueError(f"{self.quant} has no distance between codes; can build with {', '.join(Q.SYMMETRIC)}")

    def vectors(self, base: DataFrame) -> tuple[DataFrame, str]:
        """What the graph is built on, (vec_id, v): the vectors that codes stand for, and their metric."""
        metric = self.metric if self.kind == "HNSW" else "L2"
        z = Q.fit(self.quant, base, "IP" if self.quant == "SQ1" else metric)
        v = V.sound(F.col("embedding"), z.dim)
        return base.select("vec_id", z.code_vector(z.encode(v)).alias("v")), z.kind

    def build(self, base: DataFrame) -> G.Graph:
        began = time.time()
        rows, metric = self.vectors(base)
        b = written(rows, "codes")
        if self.kind == "HNSW":
            out = hnsw(b, self.R, self.L, metric)
        elif self.kind == "RNNDESCENT":
            out = rnn_descent(b, self.R)
        else:
            out = nsg(b, self.R, self.L or None, angle=self.kind == "SSG")
        self.seconds = time.time() - began
        return out

    def get_construction_time(self) -> float | None:
        return self.seconds
