"""Exact nearest neighbours of a query set, in blocks, and two-stage search with re-ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from . import codes
from . import quantizers as Q

#: Bytes of query vectors that are sent to all tasks at most, bytes of a block of vectors where there are more queries,
#: elements of a distance block, and candidates whose distances are computed anew at a time.
SENT, BLOCK, TILE, CHUNK = 64 << 20, 32 << 20, 1 << 21, 1 << 16


class _Best:
    """The k nearest rows seen of each query (ids, vectors), by (dist, vec_id).

    A matrix product gives distances up to a rounding error with a known bound. All that lie within it of the k-th
    best are computed anew, so the choice is exact whatever ties or near ties there are.
    """

    def __init__(self, q_id: np.ndarray, q: np.ndarray, k: int, kind: str, others: bool) -> None:
        self.q_id, self.q, self.k, self.kind, self.others = q_id, q, k, kind, others
        self.d = np.full((len(q), k), np.inf)
        self.i = np.full((len(q), k), np.iinfo(np.int64).max)
        self.qq = (q * q).sum(axis=1)

    def add(self, ids: np.ndarray, blocks) -> None:
        for at, y in blocks:
            step = max(1, TILE // codes.BLOCK)
            for t in range(0, len(self.q), step):
                self._block(slice(t, t + step), y, ids[at])

    def _block(self, at: slice, y, i: np.ndarray) -> None:
        q = self.q[at]
        d, error = y.near(q, self.qq[at], self.kind)
        if self.others:
            d[self.q_id[at][:, None] == i[None, :]] = np.inf
        limit = self.d[at][:, -1]
        if d.shape[1] > self.k and not np.isfinite(limit).all():  # full lists are a limit of their own
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + error)
        row, col = np.nonzero((d <= (limit + error)[:, None]) & np.isfinite(d))
        if not len(row):
            return
        dist = np.concatenate([y.exactly(q[row[c : c + CHUNK]], col[c : c + CHUNK], self.kind) for c in range(0, len(row), CHUNK)])
        had = np.isfinite(self.d[at])
        r0 = np.nonzero(had)[0]
        row, dist, own = np.concatenate((r0, row)), np.concatenate((self.d[at][had], dist)), np.concatenate((self.i[at][had], i[col]))
        order = np.lexsort((own, dist, row))
        row, dist, own = row[order], dist[order], own[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ok = place < self.k
        self.d[at][row[ok], place[ok]], self.i[at][row[ok], place[ok]] = dist[ok], own[ok]

    def batch(self):
        import pyarrow as pa

        ok = np.isfinite(self.d)
        return pa.RecordBatch.from_arrays([pa.array(self.q_id[np.nonzero(ok)[0]]), pa.array(self.i[ok]), pa.array(self.d[ok])], names=["q_id", "vec_id", "dist"])


def _nearest_of_partition(sent, read, k: int, kind: str, others: bool):
    def run(batches):
        q_id, q = sent.value
        best = _Best(q_id, q, k, kind, others)
        for b in batches:
            best.add(b.column("vec_id").to_numpy(zero_copy_only=False), read.blocks(b.column(read.column)))
        yield best.batch()

    return run


def _nearest_of_block(width: int, read, k: int, kind: str, others: bool):
    def run(key, queries, base):
        import pyarrow as pa

        best = _Best(queries.column("q_id").to_numpy(), V.matrix(queries.column("v"), width), k, kind, others)
        best.add(base.column("vec_id").to_numpy(), read.blocks(base.column(read.column)))
        return pa.Table.from_batches([best.batch()])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k rows of each query with the smallest (dist, vec_id), as q_id, rank, vec_id, dist."""
    w = Window.partitionBy("q_id").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "rank", "vec_id", "dist")


FOUND = "q_id long, vec_id long, dist double"


def nearest(queries: DataFrame, base: DataFrame, k: int, kind: str = "L2", others: bool = False, read=None) -> DataFrame:
    """q_id, rank, vec_id, dist of the k nearest base rows (vec_id, v) of each query (q_id, v).

    v: arrays of finite doubles, all of one length; any other is an error that says how many there are.

    A query set of up to SENT bytes, which is counted first, goes to all tasks, and each partition of the base keeps its
    k best. A larger one stays where it is: both sides are cut into blocks by hash, every pair of blocks is one
    group, and what is shuffled is each side once for every block of the other, as a comparison of all with all needs.
    others: leave out the base row with the query's own id. read: how blocks are read from base, by default from v.
    """
    spark, kind = queries.sparkSession, kind.upper()
    V.metric(kind)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, width = size["n"], max(size["d"] or 1, 1)
    if not n:
        return ranked(queries.select("q_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("dist")), k)
    read = read or codes.Plain(width)
    if n * width * 8 <= SENT:
        part = queries.select("q_id", "v").toArrow()
        sent = spark.sparkContext.broadcast((part["q_id"].to_numpy(), V.matrix(part["v"], width)))
        return ranked(base.select("vec_id", read.column).mapInArrow(_nearest_of_partition(sent, read, k, kind, others), FOUND), k)
    blocks = lambda rows: max(1, -(-rows * width * 8 // BLOCK))
    of_q, of_b = blocks(n), blocks(base.count())
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = queries.select("q_id", "v", own("q_id", of_q).alias("i"), each(of_b).alias("j"))
    b = base.select("vec_id", read.column, own("vec_id", of_b).alias("j"), each(of_q).alias("i"))
    return ranked(q.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_nearest_of_block(width, read, k, kind, others), FOUND), k)


def exact(queries: DataFrame, base: DataFrame, k: int, metric: str = "L2", others: bool = False) -> DataFrame:
    """Exact search on embeddings: queries (q_id, embedding), base (vec_id, embedding)."""
    q = queries.select("q_id", V.doubles(F.col("embedding")).alias("v"))
    return nearest(q, base.select("vec_id", V.doubles(F.col("embedding")).alias("v")), k, metric, others)


def flat(queries: DataFrame, base: DataFrame, k: int, quantizer: Q.Quantizer, others: bool = False) -> DataFrame:
    """Search over codes; dist is on the quantizer's scale."""
    if quantizer.name == "FP32":
        return exact(queries, base, k, quantizer.metric, others)
    return flat_codes(queries, codes.stored(base, quantizer), k, quantizer, others)


def flat_codes(queries: DataFrame, stored: DataFrame, k: int, quantizer: Q.Quantizer, others: bool = False) -> DataFrame:
    """The same over codes (vec_id, code) of :func:`codes.stored`, which may be a table."""
    v, kind = V.sound(F.col("embedding"), quantizer.dim), quantizer.kind
    qv = quantizer.query_vector(v)
    if quantizer.name == "SQ8P":
        kind = "IP"
        if quantizer.metric == "L2":  # |x|^2 - 2 x q: a dot product with one more element, 1 on the query's side
            qv = F.concat(F.transform(qv, lambda x: x * 2.0), F.array(F.lit(1.0)))
    return nearest(queries.select("q_id", qv.alias("v")), stored, k, kind, others, codes.Packed(quantizer))


def refine(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "L2", quantizer: str = "FP32") -> DataFrame:
    """Re-rank candidates (q_id, vec_id) by the distance of a better quantizer."""
    name = Q.known(quantizer)
    if name not in Q.REFINERS:
        raise ValueError(f"can't re-rank by {name}; can by {', '.join(Q.REFINERS)}")
    z = Q.fit(name, base, metric)
    v, distance = V.doubles(F.col("embedding")), V.metric(z.kind)
    b = base.select("vec_id", v.alias("_v")).select("vec_id", z.code_vector(z.encode(F.col("_v"))).alias("_b"))
    q = queries.select("q_id", z.query_vector(v).alias("_q"))
    pairs = candidates.select("q_id", "vec_id").join(b, "vec_id").join(q, "q_id")
    return ranked(pairs.select("q_id", "vec_id", distance(F.col("_q"), F.col("_b")).alias("dist")), k)


def two_stage(queries: DataFrame, base: DataFrame, k: int, metric: str, quantizer: Q.Quantizer, refiner: str = "FP32", others: bool = False, factor: float | None = None) -> DataFrame:
    """Search over codes for int(k * factor) candidates, by default the quantizer's factor, then re-rank; if that is k, there
    is nothing to re-rank."""
    wide = int(k * (factor or quantizer.factor))
    found = flat(queries, base, wide, quantizer, others)
    return found if wide == k else refine(found, queries, base, k, metric, refiner)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: how many of the true k neighbours of all queries were found, and their share."""
    both = found.where(F.col("rank") <= k).select("q_id", "vec_id").join(truth.where(F.col("rank") <= k).select("q_id", "vec_id"), ["q_id", "vec_id"])
    n = truth.agg(F.countDistinct("q_id").alias("n_queries"))
    return both.agg(F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(n)).select("hits", "n_queries", (F.col("hits") / (F.col("n_queries") * F.lit(k))).alias("recall"))
