"""Graphs as Parquet tables, and in four binary layouts through :mod:`graph_format`. Parquet is the format to keep graphs in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from . import graph_format

FORMATS = ("parquet", *graph_format.LAYOUTS)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save(graph: Graph, path: str, overwrite: bool = False) -> None:
    """edges, entries and upper layers under one folder; meta comes last, so a graph with it is whole."""
    mode = "overwrite" if overwrite else "error"
    graph.edges.write.mode(mode).parquet(f"{path}/edges")
    graph.entries.write.mode(mode).parquet(f"{path}/entries")
    if graph.upper is not None:
        graph.upper.write.mode(mode).parquet(f"{path}/upper")
    meta = [(json.dumps({"upper": graph.upper is not None}),)]
    graph.edges.sparkSession.createDataFrame(meta, "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def load(spark: SparkSession, path: str, format: str = "parquet") -> Graph:
    if format not in FORMATS:
        raise ValueError(f"unknown graph format {format!r}; known: {', '.join(FORMATS)}")
    if format == "parquet":
        has = json.loads(spark.read.text(f"{path}/meta").first()[0])["upper"]
        return Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/upper") if has else None)
    rows = graph_format.read(spark, path, format)
    entries = rows.where("layer < 0").select(F.col("dst").alias("ep"))
    upper = rows.where("layer > 0").withColumn("dist", F.lit(None).cast("double"))
    edges = rows.where("layer = 0").select("src", "pos", "dst", F.lit(None).cast("double").alias("dist"))
    return Graph(edges, entries, upper.select("layer", "src", "pos", "dst", "dist") if format == "native" and upper.limit(1).count() else None)


def build_graph(base: DataFrame, index_type: str, path: str, metric: str = "L2", quant: str = "FP32", R: int = 32, L: int = 0) -> float:
    """Build an index, save it, and return the seconds that building took."""
    from ..operators.builders import Index

    index = Index(index_type, metric, quant, R, L)
    save(index.build(base), path)
    return index.get_construction_time()
