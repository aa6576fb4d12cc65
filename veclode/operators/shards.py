"""Proximity graphs in shards: a task walks a whole shard for all queries of a block, and one merge ranks what the shards found.

Vectors are dealt to shards of about ``ROWS`` rows by k-means cells; a larger cell, as many equal or close vectors make it, is
cut by a hash. A shard's vectors, links and entry lie in one bucket of a table, so a search reads the table once,
shuffles only queries' candidates and writes nothing on its way. With a pool as wide as a shard the result is exact.

What a task holds is one shard (vectors, links) and one block of queries; a query set of up to ``knn.SENT`` bytes goes to
all tasks, a larger one is cut into blocks, each of which meets the shards it asks for. By default these are all;
``probe`` sends a query to the shards of its nearest cells only, as many shards call for.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..plans.scratch import bucketed, reopened, written
from . import codes, kmeans, knn
from . import quantizers as Q
from . import walk as W
from .builders import level

#: Rows of a shard, and rows that cells are fitted on at most.
ROWS, SAMPLE = 50_000, 200_000
NODES = "shard int, node int, vec_id long, level int, v array<double>, links array<int>, upper array<array<int>>"
FOUND = "q_id long, shard int, vec_id long, dist double, dist_cmps long"


# --- tasks: one shard ------------------------------------------------------------------------------------------------

def _lists(rows: list) -> object:
    import pyarrow as pa

    return pa.array(rows, pa.list_(pa.int32()))


def _columns(shard: W.Shard, level_: np.ndarray) -> list:
    """The links of each node and those of its layers above, nearest first, without free slots."""
    import pyarrow as pa

    trim = lambda row: row[row >= 0].tolist()
    ground = _lists([trim(r) for r in shard.links[0]])
    upper = pa.array([[trim(shard.links[k][i]) for k in range(1, level_[i] + 1)] for i in range(len(level_))], pa.list_(pa.list_(pa.int32())))
    return [ground, upper]


def _padded(rows: list, n: int) -> np.ndarray:
    out = np.full((n, max([1, *map(len, rows)])), -1)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _shard(table, x: np.ndarray) -> W.Shard:
    """The shard that rows (sorted by node) state; its entry is its first node of the top layer."""
    n, own = len(x), table.column("level").to_numpy()
    upper = table.column("upper").to_pylist()
    links = [_padded(table.column("links").to_pylist(), n)]
    for k in range(1, int(own.max(initial=0)) + 1):
        links.append(_padded([u[k - 1] if len(u) >= k else [] for u in upper], n))
    return W.Shard(x, links, int(own.argmax()) if n else 0)


def _built(m: int, width: int, kind: str, dim: int):
    def run(key, old, new):
        import pyarrow as pa

        old, new = old.sort_by("node"), new.sort_by("vec_id")
        x = np.concatenate([V.matrix(t.column("v"), dim) for t in (old, new)])
        own = np.concatenate([t.column("level").to_numpy() for t in (old, new)]).astype(np.int64)
        before = _shard(old, x[: len(old)]) if len(old) else W.Shard(x)
        shard = W.inserted(W.Shard(x, before.links, before.entry), own, m, width, kind, len(old))
        ids = pa.chunked_array([*old.column("vec_id").chunks, *new.column("vec_id").chunks], pa.int64())
        n = len(x)
        v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
        cols = [pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(own.astype(np.int32)), v, *_columns(shard, own)]
        return pa.Table.from_arrays(cols, names=["shard", "node", "vec_id", "level", "v", "links", "upper"])

    return run


def _joined_up(cap: int, kind: str, dim: int):
    """A shard of a graph that was built elsewhere: edges lead to nodes of the shard, and none of them is lost."""

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("node")
        x, own = V.matrix(table.column("v"), dim), table.column("level").to_numpy()
        shard = _shard(table, x)
        wide = np.full((len(x), max(cap, shard.links[0].shape[1])), -1)
        wide[:, : shard.links[0].shape[1]] = shard.links[0]
        shard.links[0] = wide
        r, c = np.nonzero(wide >= 0)
        dist = np.full(wide.shape, np.inf)
        dist[r, c] = W._pairs(x[r], x[wide[r, c]], kind)
        W.attach(shard, dist, kind)
        out = table.select([n for n in table.column_names if n not in ("links", "upper")])
        links, upper = _columns(shard, own)
        return out.append_column("links", pa.chunked_array([links])).append_column("upper", pa.chunked_array([upper]))

    return run


def _walked(sent, read, ef: int, k: int, kind: str, others: bool):
    """Rows found in a shard: of each query the k nearest in its pool, and how many nodes it was compared with. sent: q_id, v and
    the cells each query asks for (or None) and the cell of each shard; without it queries come as a second table."""

    def of(number: int, table, q_id: np.ndarray, q: np.ndarray):
        import pyarrow as pa

        table = table.sort_by("node")
        shard = _shard(table, read(table.column("code")))
        if len(q) and 0 < len(table) <= ef and W.reached(shard.links[0], shard.entry).all():
            # A pool as wide as the shard drops nothing, so a walk looks at every node once and ends with the nearest of all.
            best = knn._Best(q_id, q, k, kind, others)
            best.add(table.column("vec_id").to_numpy(), codes.rows(shard.x))
            ok, n = np.isfinite(best.d), W.descended(shard, q, kind)[1] + len(table)
            r = np.nonzero(ok)[0]
            return pa.Table.from_arrays([pa.array(q_id[r]), pa.array(np.full(len(r), number, np.int32)), pa.array(best.i[ok]), pa.array(best.d[ok]), pa.array(n[r])], names=["q_id", "shard", "vec_id", "dist", "dist_cmps"])
        ids, dist, n = W.search(shard, q, min(ef, len(table)), kind) if len(table) and len(q) else (np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros(0, np.int64))
        vec_id, q_id = table.column("vec_id").to_numpy(), q_id[: len(ids)]
        ok = ids >= 0
        if others and len(ids):
            ok &= vec_id[ids] != q_id[:, None]
        ok &= np.cumsum(ok, axis=1) <= k
        r, c = np.nonzero(ok)
        return pa.Table.from_arrays([pa.array(q_id[r]), pa.array(np.full(len(r), number, np.int32)), pa.array(vec_id[ids[r, c]]), pa.array(dist[r, c]), pa.array(n[r])], names=["q_id", "shard", "vec_id", "dist", "dist_cmps"])

    def run(key, table):
        q_id, q, cells, cell_of = sent.value
        asks = slice(None) if cells is None else np.flatnonzero((cells == cell_of[key[0].as_py()]).any(axis=1))
        return of(key[0].as_py(), table, q_id[asks], q[asks])

    def run_block(key, table, block):
        return of(key[0].as_py(), table, block.column("q_id").to_numpy(), V.matrix(block.column("v"), len(block.column("v")[0]) if len(block) else 0))

    return run if sent is not None else run_block


def _probed(cells: np.ndarray, probe: int):
    """The nearest cells of each query, by its vector in the space that the cells are in."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            q = V.matrix(b.column("near"), cells.shape[1])
            d = (cells * cells).sum(axis=1) - 2 * q @ cells.T
            at = np.argsort(d, axis=1, kind="stable")[:, :probe].astype(np.int32)
            asks = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("q_id"), b.column("v"), asks], names=["q_id", "v", "cells"])

    return run


def _reader(z: Q.Quantizer | None, dim: int):
    """How a shard's code column becomes vectors."""
    if z is None or z.name == "FP32":
        return lambda column: V.matrix(column, dim)
    if z.name == "PQ8":
        return lambda column: z.codebook[np.arange(len(z.codebook))[None, :], codes.bytes_of(column)].reshape(len(column), -1)
    return lambda column: codes.vectors(z, codes.bytes_of(column))


# --- the index -------------------------------------------------------------------------------------------------------

@dataclass
class ShardedGraph:
    """``nodes`` (shard, node, vec_id, level, v, links, upper), bucketed by shard, and the cells that rows are dealt by, each
    with its shards."""

    nodes: DataFrame
    buckets: int
    m: int
    width: int
    kind: str
    dim: int
    cells: np.ndarray  # centroids
    shards: list[list[int]]

    def edges(self) -> DataFrame:
        """The ground layer as edges (src, pos, dst, dist) of vec_ids."""
        e = self.nodes.select("shard", F.col("vec_id").alias("src"), F.col("v").alias("_a"), F.posexplode("links").alias("pos", "node"))
        e = e.join(self.nodes.select("shard", "node", F.col("vec_id").alias("dst"), F.col("v").alias("_b")), ["shard", "node"])
        return e.select("src", "pos", "dst", V.metric(self.kind)(F.col("_a"), F.col("_b")).alias("dist"))

    def entries(self) -> DataFrame:
        """(ep): where a search enters, one a shard."""
        first = self.nodes.groupBy("shard").agg(F.min(F.struct((-F.col("level")).alias("l"), "node", "vec_id")).alias("x"))
        return first.select(F.col("x.vec_id").alias("ep"))

    def add(self, rows: DataFrame) -> ShardedGraph:
        """The index with further rows (vec_id, v): each goes to the shard of its cell that has room, or to a new one, and is
        inserted into the graph that is there."""
        known = self.nodes.select("vec_id")
        if rows.join(known, "vec_id", "left_semi").limit(1).count():
            raise ValueError("rows hold a vec_id that the index has")
        at = {r["shard"]: r["n"] for r in self.nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
        new = written(_celled(rows, self.cells), "rows")
        put, shards, free = {}, [[*s] for s in self.shards], 1 + max(s for own in self.shards for s in own)
        for r in new.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect():  # a row a cell
            own = shards[r["cell"]]
            if own and at.get(own[-1], 0) + r["n"] <= ROWS:
                put[r["cell"]] = own[-1], 1
                continue
            put[r["cell"]] = free, -(-r["n"] // ROWS)
            own += range(free, free := free + put[r["cell"]][1])
        return _assembled(self.nodes, _put(new, put), replace(self, shards=shards))

    def save(self, path: str) -> None:
        """Into a folder: nodes in buckets, and what is needed to open them."""
        spark = self.nodes.sparkSession
        bucketed(self.nodes, "shard", "saved", self.buckets, f"{path}/nodes")
        about = {"buckets": self.buckets, "m": self.m, "width": self.width, "kind": self.kind, "dim": self.dim, "cells": self.cells.tolist(), "shards": self.shards}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> ShardedGraph:
    about = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/about").collect()))
    return ShardedGraph(reopened(spark, f"{path}/nodes", NODES, "shard", about["buckets"]), **about | {"cells": np.array(about["cells"])})


def _celled(rows: DataFrame, cells: np.ndarray) -> DataFrame:
    """rows with their cell: the nearest centroid."""
    if len(cells) == 1:
        return rows.withColumn("cell", F.lit(0))
    at = kmeans.assign(rows, cells[None]).select("vec_id", F.get("codes", F.lit(0)).alias("cell"))
    return rows.join(at, "vec_id")


def _put(celled: DataFrame, put: dict[int, tuple[int, int]]) -> DataFrame:
    """(shard, vec_id, v): the cell's first shard and how many shards its rows spread over, by a hash."""
    if not put:  # no rows
        return celled.select(F.lit(0).alias("shard"), "vec_id", "v")
    first = F.create_map(*[F.lit(x) for c, (s, _) in put.items() for x in (c, s)])[F.col("cell")]
    over = F.create_map(*[F.lit(x) for c, (_, n) in put.items() for x in (c, n)])[F.col("cell")]
    return celled.select((first + F.pmod(F.xxhash64("vec_id"), over)).cast("int").alias("shard"), "vec_id", "v")


def dealt(base: DataFrame, rows: int = ROWS) -> tuple[DataFrame, np.ndarray, list[list[int]]]:
    """(shard, vec_id, v) of base (vec_id, v), the cells' centroids, and the shards of each."""
    n = base.count()
    if n <= rows:
        first = base.select(F.size("v").alias("d")).first()
        return base.select(F.lit(0).alias("shard"), "vec_id", "v"), np.zeros((1, first["d"] if first else 0)), [[0]]
    cells = kmeans.Clustering(-(-n // rows), 5, "random", sample=SAMPLE).fit(base.withColumnRenamed("v", "embedding")).centroids
    at = written(_celled(base, cells), "cells")
    put, free = {}, 0
    for r in at.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect():  # a row a cell
        put[r["cell"]] = free, -(-r["n"] // rows)
        free += put[r["cell"]][1]
    return _put(at, put), cells, [[*range(put[c][0], sum(put[c]))] if c in put else [] for c in range(len(cells))]


def _assembled(old: DataFrame | None, new: DataFrame, like: ShardedGraph) -> ShardedGraph:
    """Insert new rows (shard, vec_id, v) into the shards of old nodes."""
    spark = new.sparkSession
    rows = new.select("shard", "vec_id", "v", level(F.col("vec_id"), like.m).alias("level"))
    old = old if old is not None else spark.createDataFrame([], NODES)
    out = old.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(_built(like.m, like.width, like.kind, like.dim), NODES)
    return ShardedGraph(bucketed(out, "shard", "nodes", like.buckets), like.buckets, like.m, like.width, like.kind, like.dim, like.cells, like.shards)


def hnsw(base: DataFrame, degree: int, width: int = 0, metric: str = "L2", rows: int = ROWS) -> ShardedGraph:
    """Hierarchical small worlds by insertion, one a shard: base (vec_id, v); ``degree`` edges a node on the ground layer at
    most, half as many above; a new node's candidates come from a search with a pool of ``width``."""
    V.metric(metric)
    first = base.select(F.size("v").alias("d")).first()
    m = max(degree // 2, 2)
    at, cells, shards = dealt(base, rows)
    return _assembled(None, at, ShardedGraph(base, _buckets(shards), m, max(width, m), metric.upper(), first["d"] if first else 0, cells, shards))


def _buckets(shards: list[list[int]]) -> int:
    return min(4096, sum(map(len, shards)))


def of_graph(graph, base: DataFrame, metric: str = "L2", rows: int = ROWS) -> ShardedGraph:
    """A graph of edges (:class:`graph.Graph`) laid out in shards; base: (vec_id, v), on which it was built. Edges between shards
    are left out, and a node that then can't be reached gets an edge; with one shard nothing is left out.

    A hierarchy's layers are those of its ``upper`` edges; the entry becomes the first node of the top layer.
    """
    first = base.select(F.size("v").alias("d")).first()
    dim = first["d"] if first else 0
    at, cells, shards = dealt(base, rows)
    up = graph.upper.select("layer", "src", "pos", "dst") if graph.upper is not None else None
    top = graph.entries.select(F.col("ep").alias("vec_id")).distinct()
    tall = up.groupBy(F.col("src").alias("vec_id")).agg(F.max("layer").alias("level")) if up is not None else None
    own = at.join(tall, "vec_id", "left") if tall is not None else at.withColumn("level", F.lit(None).cast("int"))
    highest = (own.agg(F.max("level")).first()[0] or 0) if tall is not None else 0
    # Entries are on the top layer, so a search finds them there even without an edge.
    own = own.join(top.withColumn("_ep", F.lit(True)), "vec_id", "left").withColumn("level", F.when(F.col("_ep"), F.lit(max(highest, 1))).otherwise(F.coalesce("level", F.lit(0)))).drop("_ep")
    own = own.withColumn("node", (F.row_number().over(Window.partitionBy("shard").orderBy("vec_id")) - 1).cast("int"))
    own = written(own, "numbered")
    name = own.select("shard", F.col("vec_id").alias("src")), own.select("shard", F.col("vec_id").alias("dst"), F.col("node").alias("to"))
    edges = graph.edges.select(F.lit(0).alias("layer"), "src", "pos", "dst")
    edges = edges.unionByName(up) if up is not None else edges
    inner = edges.join(name[0], "src").join(name[1], ["shard", "dst"])
    each = inner.groupBy("src", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"]).alias("l"))
    each = each.groupBy(F.col("src").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("layer", "l"))).alias("m"))
    none = F.array().cast("array<int>")
    get = lambda k: F.coalesce(F.col("m")[k], none)
    nodes = own.join(each, "vec_id", "left").select("shard", "node", "vec_id", F.col("level").cast("int").alias("level"), "v", get(F.lit(0)).alias("links"), F.when(F.col("level") > 0, F.transform(F.sequence(F.lit(1), F.greatest("level", F.lit(1))), get)).otherwise(F.array().cast("array<array<int>>")).alias("upper"))
    cap = graph.range()
    nodes = nodes.groupBy("shard").applyInArrow(_joined_up(max(cap, 2), metric.upper(), dim), NODES)
    buckets = _buckets(shards)
    return ShardedGraph(bucketed(nodes, "shard", "nodes", buckets), buckets, max(cap // 2, 2), 0, metric.upper(), dim, cells, shards)


def coded(index: ShardedGraph, base: DataFrame, z: Q.Quantizer) -> DataFrame:
    """The index's nodes with the codes that a search compares (code) in place of v: base (vec_id, embedding)."""
    if z.name == "FP32":
        c = base.select("vec_id", V.sound(F.col("embedding"), z.dim).alias("code"))
    else:
        c = codes.stored(base, z)
    return bucketed(index.nodes.drop("v").join(c, "vec_id"), "shard", "coded", index.buckets)


def search(index: ShardedGraph, nodes: DataFrame, queries: DataFrame, k: int, ef: int, kind: str, z: Q.Quantizer, others: bool = False, probe: int | None = None) -> DataFrame:
    """(q_id, shard, vec_id, dist, dist_cmps): the k nearest that each shard's walk found, from nodes of :func:`coded`.

    queries: (q_id, v) as the quantizer compares them; probe: how many cells a query asks, the nearest to its ``near``,
    which is then a third column with its vector as the index was built on.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, width = size["n"], max(size["d"] or 1, 1)
    read, asks = _reader(z, width), bool(probe) and probe < len(index.cells)
    q = queries.mapInArrow(_probed(index.cells, probe), "q_id long, v array<double>, cells array<int>") if asks else queries.select("q_id", "v")
    if n * width * 8 <= knn.SENT:
        part = q.toArrow()
        cell_of = {s: c for c, own in enumerate(index.shards) for s in own}
        cells = np.array(part["cells"].to_pylist(), np.int32).reshape(n, -1) if asks else None
        sent = queries.sparkSession.sparkContext.broadcast((part["q_id"].to_numpy(), V.matrix(part["v"], width), cells, cell_of))
        return nodes.groupBy("shard").applyInArrow(_walked(sent, read, ef, k, kind, others), FOUND)
    blocks = -(-n * width * 8 // knn.SENT)
    shards = F.flatten(F.transform("cells", lambda c: F.get(F.lit(index.shards), c))) if asks else F.sequence(F.lit(0), F.lit(sum(map(len, index.shards)) - 1))
    q = q.select("q_id", "v", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(shards).alias("shard"))
    own = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return own.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(_walked(None, read, ef, k, kind, others), FOUND)
