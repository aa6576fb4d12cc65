"""Proximity graphs as tables, and search on them in rounds.

A graph is ``edges`` (src, pos, dst, dist), ``entries`` (ep) and, for a hierarchy, ``upper`` edges with their layer.
Nothing of it is broadcast: a round of a search joins the frontier with edges and vectors, so graph and vectors may be
of any size; what a query holds is bounded by ``ef``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..plans.scratch import scratch_dir, written
from . import held, kmeans
from .knn import nearest, ranked


@dataclass
class Graph:
    edges: DataFrame
    entries: DataFrame
    upper: DataFrame | None = None  # layer, src, pos, dst, dist

    def degree_statistics(self, nodes: DataFrame) -> DataFrame:
        return degree_statistics(self.edges, nodes)

    def neighbours(self, node: int) -> DataFrame:
        """(pos, dst, dist) of one node, by pos."""
        return self.edges.where(F.col("src") == node).select("pos", "dst", "dist").orderBy("pos")

    def at(self, node: int, pos: int) -> int | None:
        """A node's neighbour number pos, or None."""
        row = self.edges.where((F.col("src") == node) & (F.col("pos") == pos)).select("dst").first()
        return row and row["dst"]

    def degree(self, node: int) -> int:
        return self.edges.where(F.col("src") == node).count()

    def size(self) -> int:
        """Nodes with an edge."""
        return self.edges.select("src").distinct().count()

    def range(self) -> int:
        """The largest degree."""
        return self.edges.agg(F.max("pos")).first()[0] + 1 if self.edges.limit(1).count() else 0


def doubled(base: DataFrame) -> DataFrame:
    return base.select("vec_id", V.doubles(F.col("embedding")).alias("v"))


def lists(edges: DataFrame, cap: int) -> DataFrame:
    """Each node's ``cap`` nearest distinct targets: src, pos, dst, dist."""
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    # Compared as it is, a rank lets each task drop what is beyond the cap before rows move, so a hub's list is bounded too.
    e = e.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("_r") <= cap)
    return e.select("src", (F.col("_r") - 1).alias("pos"), "dst", "dist")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")


def degree_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: least, largest and mean out-degree over all nodes (vec_id)."""
    n = nodes.select("vec_id").join(edges.groupBy(F.col("src").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")), "vec_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.min("n").alias("min_degree"), F.max("n").alias("max_degree"), F.avg("n").alias("avg_degree"))


def medoid(base: DataFrame) -> DataFrame:
    """One row (ep, dist): the vector nearest to the mean of all, which doesn't depend on the order of rows."""
    b = doubled(base)
    width = b.select(F.size("v").alias("d")).first()
    mean = kmeans.lloyd(b, np.zeros((1, 1, width["d"])), 1)[0] if width else np.zeros((1, 0))
    best = kmeans.assign(b, mean[None]).select(F.struct("dist", F.col("vec_id").alias("ep")).alias("x")).agg(F.min("x").alias("x"))
    return best.select("x.ep", "x.dist").where("ep is not null")


class Rounds:
    """A table that a loop adds to, a folder a round: what was added is never written again, and reading all is one scan."""

    def __init__(self, spark, name: str, schema: str) -> None:
        self.spark, self.schema, self.n = spark, schema, 0
        self.path = f"{scratch_dir(spark)}/veclode/{name}-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> DataFrame:
        part = f"{self.path}/round={self.n}"
        rows.write.parquet(part)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(part)

    def all(self) -> DataFrame:
        rows = self.spark.read.option("snapshot", self.n).schema(self.schema).parquet(self.path)
        return rows.drop("round")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(vec_id) that can be reached from start (vec_id), itself included: breadth first, a frontier at a time."""
    e, seen = edges.select("src", "dst"), Rounds(edges.sparkSession, "seen", "vec_id long")
    front = seen.add(start.select("vec_id").distinct())
    while front.limit(1).count():
        front = seen.add(front.join(e, front["vec_id"] == e["src"]).select(F.col("dst").alias("vec_id")).distinct().join(seen.all(), "vec_id", "left_anti"))
    return seen.all()


@dataclass
class Found:
    """What a search in rounds gathered: ``pool`` (q_id, vec_id, dist), the best ef of each query, and ``seen``, all it
    looked at, if that was asked for."""

    pool: DataFrame
    seen: DataFrame | None
    rounds: int


def beam(queries: DataFrame, base: DataFrame, edges: DataFrame, start: DataFrame, ef: int, metric: str = "L2", seen: bool = False) -> Found:
    """Search from start (q_id, vec_id) in rounds; queries (q_id, v), base (vec_id, v).

    A round expands all nodes of a query's best ``ef`` that are not expanded yet, and ends with one table of at most ef rows
    a query. A node that fell out of the pool can't come back, as the pool's last distance only falls, so no list
    of visited nodes is needed to end; it may be looked at twice. With ef of at least the number of reachable nodes every
    one of them is looked at, so the result is the exact one. seen: keep all (q_id, vec_id, dist) looked at.
    """
    distance = V.metric(metric)
    looked = Rounds(queries.sparkSession, "looked", "q_id long, vec_id long, dist double") if seen else None

    def measured(pairs: DataFrame) -> DataFrame:
        p = pairs.join(base.select("vec_id", F.col("v").alias("_b")), "vec_id").join(queries.select("q_id", F.col("v").alias("_q")), "q_id")
        p = p.select("q_id", "vec_id", distance(F.col("_q"), F.col("_b")).alias("dist"))
        return looked.add(p) if looked else p

    best = Window.partitionBy("q_id").orderBy("dist", "vec_id")
    pool, n = written(measured(start.select("q_id", "vec_id").distinct()).withColumn("done", F.lit(False)), "pool"), 0
    targets = edges.select("src", F.col("dst").alias("vec_id"))
    while pool.where(~F.col("done")).limit(1).count():
        front = pool.where(~F.col("done")).select("q_id", F.col("vec_id").alias("src"))
        near = front.join(targets, "src").select("q_id", "vec_id").distinct().join(pool.select("q_id", "vec_id"), ["q_id", "vec_id"], "left_anti")
        both = pool.withColumn("done", F.lit(True)).unionByName(measured(near).withColumn("done", F.lit(False)))
        pool, n = written(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= ef).drop("r"), "pool"), n + 1
    return Found(pool.drop("done"), looked.all().distinct() if looked else None, n)


def descend(graph: Graph, queries: DataFrame, base: DataFrame, metric: str, seen: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Where queries (q_id, v) enter the ground layer (q_id, vec_id), and what was looked at above it: layers above are
    searched with a pool of one. Entries are few, so every query starts at each."""
    at = queries.select("q_id").crossJoin(F.broadcast(graph.entries.select(F.col("ep").alias("vec_id"))))
    looked = []
    if graph.upper is not None:
        for layer in range(graph.upper.agg(F.max("layer")).first()[0] or 0, 0, -1):
            found = beam(queries, base, graph.upper.where(F.col("layer") == layer), at, 1, metric, seen)
            at = found.pool
            if seen:
                looked.append(found.seen)
    return at, looked


def _whole(graph: Graph, base: DataFrame, ef: int) -> DataFrame | None:
    """(vec_id) of all nodes that every search with a pool of ef looks at, where that is settled without searching: in a graph of
    one layer all queries start at its entries, and a pool as wide as the graph drops nothing, so each of them
    looks at every reachable node once."""
    if graph.upper is not None or ef < base.count():
        return None
    return reachable(graph.edges, graph.entries.select(F.col("ep").alias("vec_id")))


def _held(graph: Graph, queries: DataFrame, base: DataFrame, k: int, ef: int, metric: str, others: bool = False) -> DataFrame | None:
    """A search by tasks that hold the vectors and the lists of the graph, if both are small enough."""
    if (h := held.hold(base)) is None:
        return None
    start = held.places(h, sorted(r["ep"] for r in graph.entries.select("ep").collect()))  # entries are few
    layers = [graph.edges]
    if graph.upper is not None:
        layers = [graph.upper.where(F.col("layer") == n) for n in range(graph.upper.agg(F.max("layer")).first()[0] or 0, 0, -1)] + layers
    sent = [held.links(h, e) for e in layers]
    return None if any(x is None for x in sent) or not len(start) else held.search(h, queries, sent, start, k, ef, metric, others)


def search(graph: Graph, queries: DataFrame, base: DataFrame, k: int, ef: int = 32, metric: str = "L2", others: bool = False) -> DataFrame:
    """q_id, rank, vec_id, dist by a search on the graph; the pool holds max(k, ef). With a hierarchy, layers above are
    descended first. A pool as wide as the graph isn't kept as rows: queries meet the reachable nodes block by block.
    queries: (q_id, embedding)."""
    q = written(queries.select("q_id", V.doubles(F.col("embedding")).alias("v")), "queries")
    b = doubled(base)
    if (all_of := _whole(graph, base, max(k + others, ef))) is not None:
        return nearest(q, b.join(all_of, "vec_id", "left_semi"), k, metric, others)
    if (got := _held(graph, q, b, k, max(k + others, ef), metric, others)) is not None:
        return got.select("q_id", "rank", "vec_id", "dist")
    found = beam(q, b, graph.edges, descend(graph, q, b, metric)[0], max(k + others, ef), metric).pool
    return ranked(found.where("q_id <> vec_id") if others else found, k)


def comparisons(graph: Graph, queries: DataFrame, base: DataFrame, ef: int, metric: str = "L2") -> DataFrame:
    """q_id and dist_cmps: how many nodes a search with a pool of ef compares a query with, on all layers."""
    q = written(queries.select("q_id", V.doubles(F.col("embedding")).alias("v")), "queries")
    b = doubled(base)
    if (all_of := _whole(graph, base, ef)) is not None:
        n = b.join(all_of, "vec_id", "left_semi").agg(F.count(F.lit(1)).alias("dist_cmps")).where("dist_cmps > 0")
        return q.select("q_id").crossJoin(F.broadcast(n))
    if (got := _held(graph, q, b, 1, ef, metric)) is not None:
        return got.select("q_id", "dist_cmps")
    at, looked = descend(graph, q, b, metric, seen=True)
    looked.append(beam(q, b, graph.edges, at, ef, metric, seen=True).seen)
    rows = looked[0]
    for more in looked[1:]:  # one a layer
        rows = rows.unionByName(more)
    return rows.groupBy("q_id").agg(F.count(F.lit(1)).alias("dist_cmps"))


def groups(batches, key: str, columns: tuple[str, ...]):
    """Whole groups, as tuples of numpy columns, from batches sorted by key; a group may span batches."""
    held: list = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = []
        for c in (key, *columns):
            x = b.column(c)
            cols.append(V.matrix(x, x.value_lengths()[0].as_py() or 0) if c == "v" else x.to_numpy(zero_copy_only=False))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(cols[0])) + 1, [b.num_rows]))
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if now is not None and cols[0][s] != now:
                yield tuple(np.concatenate([h[i] for h in held]) for i in range(len(cols)))
                held = []
            now = cols[0][s]
            held.append([c[s:e] for c in cols])
    if held:
        yield tuple(np.concatenate([h[i] for h in held]) for i in range(len(held[0])))


def _occlude(cap: int, angle: bool, metric: str):
    def run(batches):
        import pyarrow as pa

        for src, dst, dist, v in groups(batches, "src", ("dst", "dist", "v")):
            kept: list[int] = []
            for i in range(len(dst)):
                if kept:
                    d = ((v[kept] - v[i]) ** 2).sum(axis=1) if metric == "L2" else -(v[kept] @ v[i])
                    if angle:  # too small an angle at src between the candidate and a kept one
                        hide = (dist[i] + dist[kept] - d) / 2 / np.sqrt(np.maximum(dist[i] * dist[kept], 1e-300)) > 0.5
                    else:
                        hide = d < dist[i]
                    if hide.any():
                        continue
                kept.append(i)
                if len(kept) == cap:
                    break
            yield pa.RecordBatch.from_arrays([pa.array(src[kept]), pa.array(np.arange(len(kept), dtype=np.int32)), pa.array(dst[kept]), pa.array(dist[kept])], names=["src", "pos", "dst", "dist"])

    return run


def pruned(candidates: DataFrame, base: DataFrame, cap: int, scan: int, angle: bool = False, metric: str = "L2") -> DataFrame:
    """Of each node's ``scan`` nearest candidates (src, dst, dist), in ascending order, those that no kept one hides, at
    most ``cap``. A kept one hides a candidate that is nearer to it than to the node, or (angle, squared L2 only) seen
    under less than 60 degrees from it; base: (vec_id, v)."""
    c = lists(candidates, scan).join(base.select(F.col("vec_id").alias("dst"), "v"), "dst")
    c = c.select("src", "dst", "dist", "v").repartition("src").sortWithinPartitions("src", "dist", "dst")
    return c.mapInArrow(_occlude(cap, angle, metric), "src long, pos int, dst long, dist double")


def linked_back(edges: DataFrame, base: DataFrame, cap: int, metric: str = "L2", scan: int | None = None) -> DataFrame:
    """Edges with their reverse ones; a node that then has more than ``cap`` is pruned anew, in one deterministic pass over its
    ``scan`` (cap + 100) nearest candidates: so many rows a node at most, whatever leads to it, are ranked or get vectors."""
    scan = scan or cap + 100
    both = written(lists(edges.select("src", "dst", "dist").unionByName(reversed_edges(edges)), scan), "both")
    many = both.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("src")
    few = both.join(many, "src", "left_anti")
    return few.unionByName(pruned(both.join(many, "src", "left_semi").select("src", "dst", "dist"), base, cap, scan, metric=metric))


#: Lost nodes x nodes with room that are compared all with all; where there are more, lost nodes search the graph.
COMPARED, FOUND = 1 << 30, 32


def grown(edges: DataFrame, entries: DataFrame, base: DataFrame, cap: int, metric: str = "L2") -> DataFrame:
    """Edges with further ones until every node is reached from the entries, none of them from a node with ``cap`` edges.

    A round attaches lost nodes that no smaller lost node points to: to the nearest of their own targets that is reached
    and has room, or to the nearest such node of all; of several that want one node's room the nearest get it. Where lost nodes
    and nodes with room are too many to compare all, lost ones search the graph for reached nodes and take the
    nearest with room in their pool; only those whose pool has no room left are compared with all.
    """
    e = written(edges.select("src", "dst", "dist"), "edges")
    while True:
        seen = reachable(e, entries.select(F.col("ep").alias("vec_id")))
        lost = written(base.select("vec_id").join(seen, "vec_id", "left_anti"), "lost")
        if not lost.limit(1).count():
            return lists(e, 2**31 - 1)
        inner = e.join(lost.withColumnRenamed("vec_id", "src"), "src", "left_semi").join(lost.withColumnRenamed("vec_id", "dst"), "dst", "left_semi")
        roots = written(lost.join(inner.where("src < dst").select(F.col("dst").alias("vec_id")).distinct(), "vec_id", "left_anti"), "roots")
        room = seen.join(e.groupBy(F.col("src").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")), "vec_id", "left").select("vec_id", (F.lit(cap) - F.coalesce("n", F.lit(0))).alias("room"))
        room = written(room.where("room > 0"), "room")
        if not room.limit(1).count():
            raise ValueError(f"no reached node has fewer than {cap} edges")
        # an edge from a lost node to a reached one, turned round
        near = e.join(roots.withColumnRenamed("vec_id", "src"), "src", "left_semi").join(room.select(F.col("vec_id").alias("dst")), "dst", "left_semi")
        near = written(near.groupBy("src").agg(F.min(F.struct("dist", "dst")).alias("x")).select(F.col("src").alias("dst"), F.col("x.dst").alias("src"), F.col("x.dist").alias("dist")), "near")
        far = roots.join(near.select(F.col("dst").alias("vec_id")), "vec_id", "left_anti").join(base, "vec_id").select(F.col("vec_id").alias("q_id"), "v")
        far = written(far, "far")
        new, to = near.select("src", "dst", "dist"), lambda found: found.select(F.col("vec_id").alias("src"), F.col("q_id").alias("dst"), "dist")
        if far.count() * room.count() > COMPARED:
            begin = far.select("q_id").crossJoin(F.broadcast(entries.select(F.col("ep").alias("vec_id"))))  # entries: one row, or few
            pool = beam(far, base, e, begin, FOUND, metric).pool.join(room.select("vec_id"), "vec_id", "left_semi")
            pool = written(ranked(pool, 1), "attached")
            new, far = new.unionByName(to(pool)), far.join(pool.select("q_id"), "q_id", "left_anti")
        new = new.unionByName(to(nearest(far, base.join(room.select("vec_id"), "vec_id", "left_semi"), 1, metric)))
        new = new.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).join(room.withColumnRenamed("vec_id", "src"), "src").where("r <= room")
        e = written(e.unionByName(new.select("src", "dst", "dist")), "edges")
