"""Searcher facade, the sweep over search widths, and the benchmark that builds, keeps and searches an index."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.scratch import written
from . import graph as G
from . import knn
from . import quantizers as Q
from . import shards


class Searcher:
    """Search on a graph by a quantizer's distances, then re-ranking by a better one if ``refine_quant`` is given."""

    def __init__(self, graph: G.Graph, base: DataFrame, metric: str = "L2", quantizer: str = "FP32", refine_quant: str = "") -> None:
        self.graph, self.base, self.metric, self.ef = graph, base, metric.upper(), 32
        self.quantizer = Q.fit(quantizer, base, metric)
        if self.quantizer.name == "SQ8P":
            raise ValueError("SQ8P codes have a scale of their own each; use flat search")
        self.refiner = Q.known(refine_quant) if refine_quant else ""
        if self.refiner and self.refiner not in Q.REFINERS:
            raise ValueError(f"can't re-rank by {self.refiner}")
        v = V.doubles(F.col("embedding"))
        self.codes = written(base.select("vec_id", self.quantizer.code_vector(self.quantizer.encode(v)).alias("embedding")), "codes")
        self._last = None

    def set_ef(self, ef: int) -> None:
        self.ef = ef

    def batch_search(self, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
        """queries: (q_id, embedding); q_id, rank, vec_id, dist. Fewer than k rows where fewer nodes were reached."""
        wide = int(k * self.quantizer.factor) if self.refiner else k
        q = queries.select("q_id", self.quantizer.query_vector(V.doubles(F.col("embedding"))).alias("embedding"))
        self._last = q, max(wide + others, self.ef)
        found = G.search(self.graph, q, self.codes, wide, self.ef, self.quantizer.kind, others)
        return found if wide == k else knn.refine(found, queries, self.base, k, self.metric, self.refiner)

    search = batch_search

    def get_last_search_dist_cmps(self) -> float:
        """Mean number of nodes that the last search compared a query with, on all layers."""
        q, ef = self._last
        return G.comparisons(self.graph, q, self.codes, ef, self.quantizer.kind).agg(F.avg("dist_cmps")).first()[0]

    def optimize(self) -> None:
        """Keeps the codes in memory; results don't change."""
        self.codes = self.codes.persist()


class ShardSearcher:
    """The same on a graph in shards: a search is one pass over the shards, and counts its comparisons on the way.

    probe: how many cells a query asks (all by default); built_on: the quantizer that the index was built on, for probing;
    graph: the whole graph that the shards were laid out from, if there is one.
    """

    def __init__(self, index: shards.ShardedGraph, base: DataFrame, metric: str = "L2", quantizer: str = "FP32", refine_quant: str = "", probe: int | None = None, built_on: Q.Quantizer | None = None, graph: G.Graph | None = None) -> None:
        self.index, self.base, self.metric, self.ef, self.probe, self.built_on, self.graph = index, base, metric.upper(), 32, probe, built_on, graph
        self.quantizer = Q.fit(quantizer, base, metric)
        if self.quantizer.name == "SQ8P":
            raise ValueError("SQ8P codes have a scale of their own each; use flat search")
        self.refiner = Q.known(refine_quant) if refine_quant else ""
        if self.refiner and self.refiner not in Q.REFINERS:
            raise ValueError(f"can't re-rank by {self.refiner}")
        self.nodes = shards.coded(index, base, self.quantizer)
        self.found: DataFrame | None = None

    def set_ef(self, ef: int) -> None:
        self.ef = ef

    def batch_search(self, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
        """queries: (q_id, embedding); q_id, rank, vec_id, dist. Fewer than k rows where fewer nodes were reached."""
        z, wide = self.quantizer, int(k * self.quantizer.factor) if self.refiner else k
        v = V.sound(F.col("embedding"), z.dim)
        q = queries.select("q_id", z.query_vector(v).alias("v"), *([(self.built_on.query_vector(v) if self.built_on else v).alias("near")] if self.probe else []))
        self.found = written(shards.search(self.index, self.nodes, q, wide, max(wide + others, self.ef), z.kind, z, others, self.probe), "found")
        found = knn.ranked(self.found.select("q_id", "vec_id", "dist"), wide)
        return found if wide == k else knn.refine(found, queries, self.base, k, self.metric, self.refiner)

    search = batch_search

    def comparisons(self) -> DataFrame:
        """q_id and dist_cmps of the last search, on all layers of all shards it asked."""
        each = self.found.groupBy("q_id", "shard").agg(F.max("dist_cmps").alias("n"))
        return each.groupBy("q_id").agg(F.sum("n").alias("dist_cmps"))

    def get_last_search_dist_cmps(self) -> float:
        return self.comparisons().agg(F.avg("dist_cmps")).first()[0]

    def optimize(self) -> None:
        """Keeps the coded shards in memory; results don't change."""
        self.nodes = self.nodes.persist()


def sweep(searcher: Searcher | ShardSearcher, queries: DataFrame, truth: DataFrame, k: int, efs: list[int], runs: int = 1) -> DataFrame:
    """ef, recall (of the first run), qps (best of runs) and mean comparisons a query: one row a search width."""
    n, out = queries.count(), []
    for ef in efs:
        searcher.set_ef(ef)
        best, share = 0.0, None
        for _ in range(runs):
            began = time.time()
            found = written(searcher.batch_search(queries, k), "found")
            best = max(best, n / (time.time() - began))
            share = share if share is not None else knn.recall(found, truth, k).first()["recall"]
        out.append((ef, share, best, searcher.get_last_search_dist_cmps()))
    return queries.sparkSession.createDataFrame(out, "ef int, recall double, qps double, dist_cmps double")


#: Fixed values of the quick benchmark.
QUICK = {"index": "HNSW", "R": 48, "L": 200, "build_quant": "SQ8U", "search_quant": "SQ4U", "refine_quant": "FP16", "k": 10, "efs": [20, 30, 40, 50, 60, 70, 80, 90, 100], "runs": 5}


class Benchmark:
    """Fit an index (or read it from a folder that keeps indexes by name and parameters), then search and sweep.

    config: the keys of QUICK, each of which may be left out.
    """

    def __init__(self, config: dict | None = None, folder: str | None = None, metric: str = "L2") -> None:
        unknown = set(config or {}) - set(QUICK)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        self.config, self.folder, self.metric = QUICK | (config or {}), folder, metric
        self.searcher: Searcher | None = None
        self.seconds: float | None = None
        self.found: DataFrame | None = None

    def path(self, name: str) -> str:
        c = self.config
        return f"{self.folder.rstrip('/')}/{name}_{c['index']}_{self.metric}_{c['build_quant']}_R{c['R']}_L{c['L']}"

    def fit(self, base: DataFrame, name: str = "data", rebuild: bool = False) -> Benchmark:
        from ..sources import graph_files
        from .builders import Index

        c, spark = self.config, base.sparkSession
        if c["index"] == "HNSW":
            return self._fit_shards(base, name, rebuild)
        graph = None
        if self.folder and not rebuild and graph_files.exists(spark, self.path(name) + "/meta/_SUCCESS"):
            graph = graph_files.load(spark, self.path(name))
        if graph is None:
            index = Index(c["index"], self.metric, c["build_quant"], c["R"], c["L"])
            graph = index.build(base)
            self.seconds = index.get_construction_time()
            if self.folder:
                graph_files.save(graph, self.path(name), overwrite=True)
                graph = graph_files.load(spark, self.path(name))
        rows, kind = Index(c["index"], self.metric, c["build_quant"], c["R"], c["L"]).vectors(base)
        self.searcher = ShardSearcher(shards.of_graph(graph, rows, kind), base, self.metric, c["search_quant"], c["refine_quant"], graph=graph)
        return self

    def _fit_shards(self, base: DataFrame, name: str, rebuild: bool) -> Benchmark:
        from ..sources import graph_files
        from .builders import Index

        c, spark = self.config, base.sparkSession
        if self.folder and not rebuild and graph_files.exists(spark, self.path(name) + "/about/_SUCCESS"):
            graph = shards.load(spark, self.path(name))
        else:
            began = time.time()
            rows, kind = Index("HNSW", self.metric, c["build_quant"], c["R"], c["L"]).vectors(base)
            graph = shards.hnsw(written(rows, "codes"), c["R"], c["L"], kind)
            self.seconds = time.time() - began
            if self.folder:
                graph.save(self.path(name))
                graph = shards.load(spark, self.path(name))
        self.searcher = ShardSearcher(graph, base, self.metric, c["search_quant"], c["refine_quant"])
        return self

    def set_query_arguments(self, ef: int) -> None:
        self.searcher.set_ef(ef)

    def query(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        self.found = self.searcher.batch_search(queries, k or self.config["k"])
        return self.found

    def sweep(self, queries: DataFrame, truth: DataFrame, to: str | None = None) -> DataFrame:
        """ef, recall, qps, dist_cmps and build_seconds (null if the index was read); to: a folder that gets the rows as CSV."""
        rows = sweep(self.searcher, queries, truth, self.config["k"], self.config["efs"], self.config["runs"])
        rows = rows.withColumn("build_seconds", F.lit(self.seconds).cast("double"))
        if to:
            rows.coalesce(1).write.option("header", True).csv(to)
        return rows
