"""Shared pieces of the training-data operators: words, scratch tables, document keys."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import bucketed, reopened, scratch_dir  # noqa: F401  the operators' scratch folder and tables

#: A word is a run of characters other than ASCII white space. ``bytes.split()`` splits at the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"


def squeezed(text: Column) -> Column:
    """The words joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def n_words(text: Column) -> Column:
    """Number of words, as a long."""
    t = squeezed(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/veclode/{name}-{uuid.uuid4().hex}"
    out = df.write.partitionBy(*by) if by else df.write
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that an Arrow batch may gather.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds, unless the session has a lower bound already. The bound stays in the
    session, as results are lazy. A longer text is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def keyed(docs: DataFrame, name: str, whole: bool = False) -> tuple[DataFrame, bool]:
    """(rid, doc_id, text) of docs, where rid tells rows apart, and whether rid is doc_id itself; whole: also ``row``,
    a struct of all columns.

    Where doc_id is unique and never null, rid is doc_id. Otherwise rows get numbers in a written table, so that
    repeated rows and rows without an id stay apart and a task run again sees the same numbers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct("*").alias("row")] if whole else []))
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    odd = ids.where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("rid"), "*"), True
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), "*"), name), False


# --- vectorised names (fingerprints) of byte strings and word sequences -------------------------------------------

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def texts(batch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column laid end to end, and the n + 1 places where they begin and end."""
    import pyarrow as pa

    if pa.types.is_large_string(batch.type):
        kind = np.int64
    else:
        kind = np.int32
    col = batch.fill_null("")
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: A random 64-bit number for each byte value, the same everywhere.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * M1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spans_of(ends: np.ndarray, limit: int = 1 << 20):
    """Ranges [i, j) of documents that hold at most ``limit`` bytes together, or one longer document, which is taken whole:
    a task's memory is bounded by the longest text."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _zipped(batches):
    import pyarrow as pa

    for b in batches:
        text = pa.array([pa.compress((t or "").encode(), codec="zstd", asbytes=True) for t in b.column("text").to_pylist()], pa.binary())
        size = pa.array([len((t or "").encode()) for t in b.column("text").to_pylist()], pa.int32())
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], size, text], names=[*keep, "size", "zipped"])


def zipped(df: DataFrame) -> DataFrame:
    """df with ``size`` and ``zipped`` in place of text: what a shuffle and a table of texts then hold is under half."""
    cols = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text"]
    return df.mapInArrow(_zipped, ", ".join([*cols, "size int", "zipped binary"]))


def unzipped(b):
    """The texts of a batch of such rows, as an Arrow column."""
    import pyarrow as pa

    got = [pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for z, n in zip(b.column("zipped").to_pylist(), b.column("size").to_pylist(), strict=True)]
    return pa.array(got, pa.binary()).cast(pa.string())
