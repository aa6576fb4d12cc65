"""A Spark data source for graphs in binary layouts: read in byte ranges, written in parts.

A file, or a folder whose files in the order of their names are one, is cut into ranges of about ``SPLIT`` bytes. Rows of a fixed
width are found by their number; lists that begin with their length are found by one streaming pass over the file
that keeps an offset for every range. A task reads its range a piece at a time.

The native layout is written by all tasks at once: each has a range of nodes, sorted, and writes it as a part of its own; the
parts' names put them in order, so that ``cat folder/*`` is the file. Tasks write under names of their own attempt,
which the commit renames. Files are reached through pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed value: the name of the source. Bytes of a range, and of a piece that is read at a time.
NAME, SPLIT, PIECE = "veclode_graph", 16 << 20, 4 << 20
LAYOUTS = ("native", "diskann", "nsg", "hnswlib")
ROWS = "layer int, src long, pos int, dst long"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class Bytes:
    """A file, or a folder's files end to end."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, root = _files(path)
        at = self.fs.get_file_info(root)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        parts = [at] if at.type == fs.FileType.File else sorted((f for f in self.fs.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
        self.paths, self.ends = [f.path for f in parts], np.cumsum([0, *(f.size for f in parts)])
        self.size = int(self.ends[-1])

    def read(self, at: int, n: int) -> bytes:
        """n bytes from at on, or fewer at the end."""
        out, end = [], min(at + n, self.size)
        for path, a, b in zip(self.paths, self.ends[:-1], self.ends[1:], strict=True):
            if a < end and b > at:
                with self.fs.open_input_file(path) as f:
                    out.append(f.read_at(int(min(b, end) - max(a, at)), int(max(a, at) - a)))
        return b"".join(out)

    def numbers(self, kind: str, at: int) -> tuple:
        return struct.unpack(f"<{kind}", self.read(at, struct.calcsize(f"<{kind}")))


@dataclass
class Range(InputPartition):
    """Bytes [start, end) that hold rows from number ``first`` on. width: numbers of a padded row; size: bytes of a row of fixed
    size that begins with its length; both 0: lists. entries: no bytes, but entry points. layers: rows are whole hierarchies."""

    start: int = 0
    end: int = 0
    first: int = 0
    width: int = 0
    size: int = 0
    entries: tuple[int, ...] = ()
    layers: int = 0

    def __post_init__(self) -> None:
        super().__init__(self.first)


def _fixed(start: int, rows: int, each: int, split: int, **about) -> list[Range]:
    """Ranges of rows of ``each`` bytes."""
    step = max(1, split // max(each, 1))
    return [Range(start + r * each, start + min(rows, r + step) * each, r, **about) for r in range(0, rows, step)]


def _lists(data: Bytes, start: int, end: int, split: int, rows: int | None = None, **about) -> list[Range]:
    """Ranges of lists, found by their lengths."""
    out, at, first, n, held, base = [], start, 0, 0, b"", start
    begin = start
    while at < end and (rows is None or n < rows):
        if at + 4 > base + len(held):
            base, held = at, data.read(at, PIECE)
        (k,) = struct.unpack_from("<i", held, at - base)
        if k < 0:
            raise ValueError(f"a list at byte {at} has a negative length")
        at, n = at + 4 + 4 * k, n + 1
        if at - begin >= split:
            out.append(Range(begin, at, first, **about))
            begin, first = at, n
    if at > data.size or at > end:
        raise ValueError("the last list ends beyond the file")
    return [*out, Range(begin, at, first, **about)] if at > begin else out


def plan(data: Bytes, layout: str, split: int = SPLIT) -> list[Range]:
    """The ranges of a file."""
    if layout == "native":
        (n,) = data.numbers("i", 0)
        eps = data.numbers(f"{n}i", 4)
        rows, width = data.numbers("ii", 4 + 4 * n)
        at = 12 + 4 * n
        out = _fixed(at, rows, 4 * width, split, width=width)
        at += 4 * rows * width
        if at < data.size:
            rows, width, ep = data.numbers("iii", at)
            eps, out = (ep,), [*out, *_lists(data, at + 12, data.size, split, rows, layers=width)]
    elif layout == "diskann":
        size, _, ep = data.numbers("QIi", 0)
        eps, out = (ep,), _lists(data, 24, size, split)
    elif layout == "nsg":
        _, ep = data.numbers("ii", 0)
        eps, out = (ep,), _lists(data, 8, data.size, split)
    else:
        _, rows, _, size, _, _, level, ep, _, _ = data.numbers("QQQQQQiiQQ", 0)
        if level > 1:
            raise ValueError("a file of this layout with more than one upper layer isn't supported")
        eps, out = (ep,), _fixed(96, rows, size, split, size=size)
    return [Range(entries=tuple(eps)), *out]


def _batch(layer, src, pos, dst):
    import pyarrow as pa

    cols = [pa.array(np.ascontiguousarray(x, t)) for x, t in ((layer, np.int32), (src, np.int64), (pos, np.int32), (dst, np.int64))]
    return pa.RecordBatch.from_arrays(cols, names=["layer", "src", "pos", "dst"])


def _padded(ids: np.ndarray, first: int):
    src, pos = np.nonzero(ids >= 0)
    return _batch(np.zeros(len(src)), src + first, pos, ids[src, pos])


def rows_of(data: Bytes, r: Range) -> Iterator:
    """Arrow batches (layer, src, pos, dst) of a range; entry points have layer -1."""
    if r.entries:
        n = len(r.entries)
        yield _batch(np.full(n, -1), np.full(n, -1), np.arange(n), np.array(r.entries))
        return
    if r.width or r.size:
        size = r.size or 4 * r.width
        step = max(1, PIECE // size) * size
        for at in range(r.start, r.end, step):
            raw = np.frombuffer(data.read(at, min(step, r.end - at)), np.uint8).reshape(-1, size)
            first = r.first + (at - r.start) // size
            if r.width:
                yield _padded(np.ascontiguousarray(raw).view("<i4"), first)
                continue
            k = np.ascontiguousarray(raw[:, :4]).view("<i4")[:, 0]
            ids = np.ascontiguousarray(raw[:, 4 : 4 + 4 * int(k.max(initial=0))]).view("<i4").reshape(len(raw), -1)
            yield _padded(np.where(np.arange(ids.shape[1]) < k[:, None], ids, -1), first)
        return
    at, n, out = r.start, r.first, []
    held = data.read(r.start, r.end - r.start)  # about SPLIT bytes, or one longer list
    while at < r.end:
        (k,) = struct.unpack_from("<i", held, at - r.start)
        ids = np.frombuffer(held, "<i4", k, at - r.start + 4)
        if r.layers:
            layer, pos = np.nonzero(ids.reshape(-1, r.layers) >= 0)
            out.append((layer + 1, np.full(len(pos), n), pos, ids.reshape(-1, r.layers)[layer, pos]))
        else:
            out.append((np.zeros(k), np.full(k, n), np.arange(k), ids))
        at, n = at + 4 + 4 * k, n + 1
    if out:
        yield _batch(*(np.concatenate([x[i] for x in out]) for i in range(4)))


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.layout, self.split = options["path"], options.get("layout", "native"), int(options.get("split", SPLIT))
        if self.layout not in LAYOUTS:
            raise ValueError(f"unknown graph layout {self.layout!r}; known: {', '.join(LAYOUTS)}")

    def partitions(self):
        return plan(Bytes(self.path), self.layout, self.split)

    def read(self, partition):
        yield from rows_of(Bytes(self.path), partition)


@dataclass
class _Part(WriterCommitMessage):
    name: str
    first: int
    rows: int


class _Writer(DataSourceWriter):
    """Rows (src, ids), sorted by src and a range of them a task, as one kind of parts of the native layout."""

    def __init__(self, options) -> None:
        self.path, self.kind, self.width, self.n = options["path"], options["kind"], int(options["width"]), int(options["n"])
        self.head = bytes.fromhex(options["head"])

    def write(self, iterator):
        fs, root = _files(self.path)
        name, first, rows, held, size = f"_{self.kind}-{uuid.uuid4().hex}", -1, 0, [], 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            for r in iterator:
                src, ids = r["src"], np.array(r["ids"], "<i4")
                if rows and src != first + rows:
                    raise ValueError(f"node {first + rows} is missing")
                first, rows = (src if not rows else first), rows + 1
                piece = np.full(self.width, -1, "<i4") if self.kind == "1-ground" else np.concatenate((np.array([len(ids)], "<i4"), ids))
                if self.kind == "1-ground":
                    piece[: len(ids)] = ids
                held.append(piece.tobytes())
                size += len(held[-1])
                if size >= PIECE:
                    out.write(b"".join(held))
                    held, size = [], 0
            out.write(b"".join(held))
        return _Part(name, first, rows)

    def commit(self, messages):
        fs, root = _files(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        upto = 0
        for m in parts:
            if m.first != upto:
                raise ValueError(f"node {upto} is missing")
            upto += m.rows
        if upto != self.n:
            raise ValueError(f"{upto} of {self.n} nodes were written")
        for m in parts:
            fs.move(f"{root}/{m.name}", f"{root}/{self.kind}-{m.first:015d}")
        with fs.open_output_stream(f"{root}/{int(self.kind[0]) - 1}{self.kind[1:]}-head") as out:
            out.write(self.head)
        self.abort([m for m in messages if m is not None and not m.rows])

    def abort(self, messages):
        fs, root = _files(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


class GraphFormat(DataSource):
    """``spark.read.format(NAME).option("layout", ...).load(path)``; options: layout, split."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options)


def read(spark: SparkSession, path: str, layout: str, split: int = SPLIT) -> DataFrame:
    """(layer, src, pos, dst): edges of all layers, and entry points as dst of layer -1."""
    spark.dataSource.register(GraphFormat)
    return spark.read.format(NAME).option("layout", layout).option("split", split).load(path)


def write_native(graph, nodes: DataFrame, path: str) -> None:
    """A graph whose nodes (vec_id) are 0 to n - 1 into a new folder, in the native layout, with its hierarchy if it has one."""
    spark = nodes.sparkSession
    spark.dataSource.register(GraphFormat)
    about = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).first()
    n = about["n"]
    if n and (about["lo"], about["hi"]) != (0, n - 1):
        raise ValueError("the native layout numbers nodes from 0 without gaps")
    eps = [r["ep"] for r in graph.entries.orderBy("ep").limit(1 << 20).collect()]  # entry points are few: they are a header

    def put(rows: DataFrame, kind: str, width: int, head: bytes) -> None:
        rows = nodes.select(F.col("vec_id").alias("src")).join(rows, "src", "left").select("src", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
        rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").sortWithinPartitions("src")
        rows.write.format(NAME).mode("append").option("kind", kind).option("width", width).option("n", n).option("head", head.hex()).save(path)

    lists = lambda e: e.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"].cast("int")).alias("ids"))
    width = graph.range()
    put(lists(graph.edges), "1-ground", width, struct.pack(f"<i{len(eps)}iii", len(eps), *eps, n, width))
    if graph.upper is None:
        return
    width = (graph.upper.agg(F.max("pos")).first()[0] or 0) + 1
    high = lists(graph.upper.withColumn("src", F.struct("src", "layer"))).select("src.src", "src.layer", "ids")
    pad = lambda ids: F.concat(ids, F.array_repeat(F.lit(-1), F.lit(width) - F.size(ids)))
    high = high.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("layer", pad(F.col("ids"))))).alias("m"), F.max("layer").alias("top"))
    none = F.array_repeat(F.lit(-1), F.lit(width))
    high = high.select("src", F.flatten(F.transform(F.sequence(F.lit(1), F.col("top")), lambda k: F.coalesce(F.col("m")[k], none))).alias("ids"))
    put(high, "3-upper", width, struct.pack("<iii", n, width, eps[0] if eps else 0))
