import struct

import pytest
from pyspark.sql import functions as F

from veclode.operators.graph import Graph
from veclode.sources import datasets, graph_files, graph_format

LISTS = [[1, 2], [0], [0, 1], []]
EDGES = sorted((i, p, d) for i, ids in enumerate(LISTS) for p, d in enumerate(ids))


def ints(*x):
    return struct.pack(f"<{len(x)}i", *x)


def content(kind):
    ragged = b"".join(ints(len(x), *x) for x in LISTS)
    if kind == "nsg":
        return ints(2, 3) + ragged
    if kind == "diskann":
        return struct.pack("<QiiQ", 24 + len(ragged), 2, 3, 0) + ragged
    if kind == "hnswlib":
        return struct.pack("<QQQQQQiiQQ", 0, 4, 4, 20, 0, 0, 1, 3, 2, 2) + b"\0" * 24 + b"".join((ints(len(x), *x) + b"\7" * 20)[:20] for x in LISTS)
    padded = b"".join(ints(*(x + [-1, -1])[:2]) for x in LISTS)
    return ints(1, 3, 4, 2) + padded + ints(4, 1, 2) + ints(0, 0, 2, 0, -1, 0)


@pytest.mark.parametrize("kind", ["native", "diskann", "nsg", "hnswlib"])
def test_binary_layouts(spark, tmp_path, kind):
    (tmp_path / "g").write_bytes(content(kind))
    g = graph_files.load(spark, f"file://{tmp_path}/g", kind)
    assert sorted((r["src"], r["pos"], r["dst"]) for r in g.edges.collect()) == EDGES
    assert [r["ep"] for r in g.entries.collect()] == [2 if kind == "native" else 3]
    if kind == "native":
        assert [(r["layer"], r["src"], r["dst"]) for r in g.upper.collect()] == [(1, 2, 0)]


def test_parquet_round_trip_and_unknown(spark, tmp_path):
    e = spark.createDataFrame([(0, 0, 1, 0.5)], "src long, pos int, dst long, dist double")
    graph_files.save(Graph(e, spark.range(1).select(F.col("id").alias("ep"))), f"file://{tmp_path}/p")
    g = graph_files.load(spark, f"file://{tmp_path}/p")
    assert g.edges.collect() == e.collect() and g.upper is None
    with pytest.raises(ValueError):
        graph_files.load(spark, "x", "other")


def test_datasets(spark, tmp_path):
    at = f"file://{tmp_path}/glove-25-angular"
    spark.createDataFrame([(0, [3.0, 4.0])], "vec_id long, embedding array<double>").write.parquet(at + "/base")
    d = datasets.dataset(spark, "glove-25-angular", f"file://{tmp_path}")
    assert d.metric == "IP" and d.get_database().first()["embedding"] == [0.6, 0.8]
    with pytest.raises(ValueError):
        datasets.dataset(spark, "x")
    with pytest.raises(ValueError):
        datasets.validated(spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_build_graph_saves_what_it_built(spark, tmp_path):
    b = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(20)], "vec_id long, embedding array<double>")
    assert graph_files.build_graph(b, "HNSW", f"file://{tmp_path}/h", R=8, L=8) > 0
    g = graph_files.load(spark, f"file://{tmp_path}/h")
    assert g.edges.select("src").distinct().count() == 20 and g.entries.count() == 1
    assert {r["layer"] for r in g.upper.collect()} <= {1, 2, 3} if g.upper is not None else True


@pytest.mark.parametrize("kind", ["native", "diskann", "nsg", "hnswlib"])
def test_byte_ranges(spark, tmp_path, monkeypatch, kind):
    """A file in many ranges, and cut into a folder of parts at any byte, reads the same."""
    (tmp_path / "g").write_bytes(content(kind))
    whole = sorted(map(tuple, graph_format.read(spark, f"file://{tmp_path}/g", kind).collect()))
    ranges = graph_format.plan(graph_format.Bytes(f"{tmp_path}/g"), kind, 8)
    assert len(ranges) >= 4
    cut = graph_format.read(spark, f"file://{tmp_path}/g", kind, 8)
    assert sorted(map(tuple, cut.collect())) == whole and cut.rdd.getNumPartitions() == len(ranges)
    (tmp_path / "parts").mkdir()
    for i in range(0, len(content(kind)), 7):
        (tmp_path / "parts" / f"{i:04d}").write_bytes(content(kind)[i : i + 7])
    assert sorted(map(tuple, graph_format.read(spark, str(tmp_path / "parts"), kind, 12).collect())) == whole


def test_native_round_trip_with_layers(spark, tmp_path):
    edges = [(i, p, (i * 7 + p * 3 + 1) % 500) for i in range(500) for p in range(i % 5)]
    upper = [(layer, i, p, (i + 40 * (p + 1)) % 500) for i in range(0, 500, 40) for layer in (1, 2) if i % (40 * layer) == 0 for p in range(1 + layer)]
    g = Graph(spark.createDataFrame(edges, "src long, pos int, dst long").repartition(5), spark.createDataFrame([(0,)], "ep long"), spark.createDataFrame(upper, "layer int, src long, pos int, dst long"))
    nodes = spark.range(500).select(F.col("id").alias("vec_id"))
    graph_format.write_native(g, nodes, f"file://{tmp_path}/native")
    names = sorted(p.name for p in (tmp_path / "native").iterdir())
    assert names[0] == "0-ground-head" and "2-upper-head" in names and sum(n.startswith("1-ground") for n in names) >= 2
    (tmp_path / "one").write_bytes(b"".join((tmp_path / "native" / n).read_bytes() for n in names))
    for path, split in ((f"file://{tmp_path}/native", 1000), (f"file://{tmp_path}/one", 1000), (f"file://{tmp_path}/one", 1 << 20)):
        rows = graph_format.read(spark, path, "native", split)
        assert sorted(map(tuple, rows.where("layer = 0").select("src", "pos", "dst").collect())) == sorted(edges)
        assert sorted(map(tuple, rows.where("layer > 0").collect())) == sorted(upper)
    back = graph_files.load(spark, f"file://{tmp_path}/native", "native")
    assert [r["ep"] for r in back.entries.collect()] == [0] and back.size() == 400
    with pytest.raises(ValueError, match="gaps"):
        graph_format.write_native(g, nodes.where("vec_id <> 3"), f"file://{tmp_path}/other")


def test_broken_files(spark, tmp_path):
    (tmp_path / "g").write_bytes(content("nsg")[:-6])
    with pytest.raises(Exception, match="beyond the file"):
        graph_format.plan(graph_format.Bytes(f"{tmp_path}/g"), "nsg")
    with pytest.raises(FileNotFoundError):
        graph_format.Bytes(f"{tmp_path}/none")
