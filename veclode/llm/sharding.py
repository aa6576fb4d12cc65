"""Sharding by a hierarchical weighted hash tree.

A document walks down the tree: region, then rack, then shard. At every level each child of the node draws a number
from the hash of (seed, level, child, doc_id) and the document goes to the child with the smallest
``-ln(draw) / weight``. A child's draw depends on nothing but itself, so a change of weights moves documents only into
or out of the subtree whose weight changed. Only built-in functions are used.

Cases: a null text has no bytes (size 16, CRC of the empty string); texts of any length only count; a null doc_id draws
as the empty string, so all such rows share a shard; repeated rows share a shard and get slots of their own, in the order
of ``ties``, beyond which rows are equal; equal draws go to the lower child; an empty table gives no rows; further columns
are ignored by the query and kept by :func:`assign`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

SHARDS, RACK, RACKS, SEED = 40, 5, 2, "tree-1"
#: Slots are numbered within hash ranges of a shard of about this many rows, so that no task numbers a whole shard.
RANGE_ROWS = 1 << 17


def topology(shards: int, rack: int = RACK, racks: int = RACKS) -> dict[int, dict[int, list[int]]]:
    """region -> rack -> shards: racks of ``rack`` shards, regions of ``racks`` racks; a further shard opens a new region."""
    tree: dict[int, dict[int, list[int]]] = {}
    for s in range(shards):
        tree.setdefault(s // (rack * racks), {}).setdefault(s // rack, []).append(s)
    return tree


def draw(key: Column, level: str, child: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1] from 48 bits of an MD5."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:{level}"), child.cast("string"), F.lit(":"), key).cast("binary")), 1, 12)
    return -F.log((F.conv(h, 16, 10).cast("double") + 1) / F.lit(float(2**48))) / weight


def _descend(key: Column, level: str, children: Column, seed: str) -> Column:
    """The child with the lowest draw (the lower child on ties); children: an array of (c, w)."""
    return F.array_min(F.transform(children, lambda x: F.struct(draw(key, level, x["c"], x["w"], seed).alias("s"), x["c"].alias("c"))))["c"]


def _children(nodes: dict[int, list[tuple[int, float]]]) -> Column:
    """node -> its children with their weights, as a literal map."""
    pairs = [x for n, cc in nodes.items() for x in (F.lit(n), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in cc]))]
    return F.create_map(*pairs)


def shard_of(doc_id: Column, tree: dict[int, dict[int, list[int]]], weights: dict[int, float] | None = None, seed: str = SEED) -> Column:
    """The shard of a document; weights are by shard, 1 unless given, and sum up the tree."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    w = lambda ss: sum((weights or {}).get(s, 1.0) for s in ss)
    regions = {0: [(r, sum(w(ss) for ss in kk.values())) for r, kk in tree.items()]}
    racks = {r: [(k, w(ss)) for k, ss in kk.items()] for r, kk in tree.items()}
    shards = {k: [(s, w([s])) for s in ss] for kk in tree.values() for k, ss in kk.items()}
    region = _descend(key, "r", _children(regions)[0], seed)
    rack = _descend(key, "k", _children(racks)[region], seed)
    return _descend(key, "s", _children(shards)[rack], seed).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None, seed: str = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """docs with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (with one more shard).

    Slots follow (hash range of doc_id and ties, doc_id, ties). The ties also spread rows that share a doc_id, or have none, over
    the ranges.
    """
    ranges = max(1, docs.count() // (RANGE_ROWS * shards) + 1) * 16
    put = docs.withColumns({
        "shard": shard_of(F.col("doc_id"), topology(shards), weights, seed),
        "grown_shard": shard_of(F.col("doc_id"), topology(shards + 1), weights, seed),
        "_range": F.pmod(F.xxhash64(F.lit(f"{seed}:slot"), "doc_id", *ties), F.lit(ranges)),
    })
    # Counts by (shard, range): the base of each range is a running sum over them, a row for RANGE_ROWS rows or fewer.
    base = (
        put.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n"))
        .drop("_n")
    )
    at = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("doc_id", *ties))
    return put.withColumn("_at", at).join(base, ["shard", "_range"]).withColumn("slot", F.col("_base") + F.col("_at") - 1).drop("_base", "_at", "_range")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law ``key``: doc_id and the number of shards decide, and one more shard
    takes rows only into itself.

    Cases: a null text has size 16 and the CRC of the empty string; null doc_ids share a shard; rows that repeat a doc_id
    are told apart by CRC and size, those equal in both are equal rows; texts of any length are only measured; further
    columns are ignored; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(rows, ties=("text_crc32", "size")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
