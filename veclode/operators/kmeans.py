"""Lloyd's k-means on whole vectors or on each of their sub-spaces (a product quantizer's codebook).

Centroids are a small array [sub-space][centroid][element] (their number is a parameter) that goes to the tasks as a
broadcast or with a function, never into a plan. A round is one pass in which each task assigns its rows and adds them up,
and one aggregation of what the tasks found; sums are of integers on a grid that is as fine as the largest value and the
number of rows allow (:func:`unit`), so they don't depend on the order of rows, and a round gives the same centroids on any
cluster. An empty cluster becomes the zero vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V


def unit(base: DataFrame) -> float:
    """The grid's steps to one: a power of two so that the values of all rows (v) fit a 64-bit sum."""
    r = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    if not np.isfinite(r["m"] or 0.0):
        raise ValueError("vectors have elements that aren't finite")
    return steps(r["m"] or 0.0, r["n"])


def steps(most: float, n: int) -> float:
    if not most or not n:
        return 1.0
    return 2.0 ** max(-900, min(900, 61 - math.ceil(math.log2(most)) - math.ceil(math.log2(n))))


def _codes(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows [row][sub-space][element] the nearest centroid in each sub-space (the lowest on ties), and the distance."""
    n, k, sd = c.shape
    code, dist = np.empty((len(x), n), np.int32), np.empty((len(x), n))
    step = max(1, (1 << 21) // k)
    for s in range(n):
        for t in range(0, len(x), step):
            d = np.zeros((len(x[t : t + step]), k))
            for j in range(sd):  # in the order of the elements, like the column expressions
                e = x[t : t + step, s, j, None] - c[s, None, :, j]
                d += e * e
            code[t : t + step, s] = d.argmin(axis=1)
            dist[t : t + step, s] = d.min(axis=1)
    return code, dist


def _rows_of(b, c: np.ndarray) -> np.ndarray:
    n, _, sd = c.shape
    lengths = b.column("v").value_lengths()
    return V.matrix(b.column("v"), max(lengths[0].as_py() or 0, n * sd))[:, : n * sd].reshape(b.num_rows, n, sd)


def _lists(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _assign(sent):
    def run(batches):
        import pyarrow as pa

        c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows_of(b, c)
            code, dist = _codes(x, c)
            near = c[np.arange(c.shape[0])[None, :], code]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _lists(code), pa.array(dist[:, 0]), _lists((x - near).reshape(len(x), -1))], names=["vec_id", "codes", "dist", "residual"])

    return run


def assign(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Of base (vec_id, v): codes (the nearest centroid in each sub-space), dist to the first of them, residual of all."""
    sent = base.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))
    return base.select("vec_id", "v").mapInArrow(_assign(sent), "vec_id long, codes array<int>, dist double, residual array<double>")


def _sums(sent, grid: float):
    """What a task's rows add up to: sub-space, centroid, element, sum on the grid, rows."""

    def run(batches):
        import pyarrow as pa

        c = sent.value
        n, k, sd = c.shape
        total, rows = np.zeros((n * k, sd), np.int64), np.zeros(n * k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows_of(b, c)
            at = (_codes(x, c)[0] + np.arange(n) * k).ravel()
            np.add.at(total, at, np.floor(x.reshape(-1, sd) * grid + 0.5).astype(np.int64))
            rows += np.bincount(at, minlength=n * k)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), _lists(total[at]), pa.array(rows[at])], names=["at", "t", "n"])

    return run


def _as_doubles(total: np.ndarray) -> np.ndarray:
    """64-bit sums as doubles. A negative sum s is rounded as -s - 1 is and then less one, which is how the SQL's engine casts
    the sums of its integers; beyond 2**53 that differs from plain rounding in the last bit."""
    return np.where(total < 0, -(~total).astype(np.float64) - 1.0, total.astype(np.float64))


def lloyd(base: DataFrame, centroids: np.ndarray, epochs: int) -> np.ndarray:
    """A fixed number of rounds from given centroids; base: (vec_id, v)."""
    grid, (n, k, sd) = unit(base), centroids.shape
    for _ in range(epochs):
        sent = base.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))
        part = base.select("v").mapInArrow(_sums(sent, grid), "at long, t array<long>, n long")
        got = part.groupBy("at").agg(*[F.sum(F.get("t", F.lit(j))).alias(f"t{j}") for j in range(sd)], F.sum("n").alias("n")).toPandas()
        centroids = np.zeros((n * k, sd))
        centroids[got["at"]] = _as_doubles(got[[f"t{j}" for j in range(sd)]].to_numpy(np.int64)) / grid / got["n"].to_numpy(np.float64)[:, None]
        centroids = centroids.reshape(n, k, sd)
    return centroids


def _stacked(v) -> np.ndarray:
    return np.array(v.tolist(), np.float64)


def nearest(v: Column, centroids: np.ndarray) -> Column:
    """For each sub-space of v the nearest centroid (the lowest on ties)."""
    c = np.asarray(centroids, np.float64)
    n, _, sd = c.shape

    @F.pandas_udf("array<int>")
    def code(x: pd.Series) -> pd.Series:
        return pd.Series(list(_codes(_stacked(x)[:, : n * sd].reshape(len(x), n, sd), c)[0])) if len(x) else x

    return code(v)


def reconstructed(codes: Column, centroids: np.ndarray) -> Column:
    """The vector that codes stand for: their centroids end to end."""
    c = np.asarray(centroids, np.float64)

    @F.pandas_udf("array<double>")
    def vector(x: pd.Series) -> pd.Series:
        if not len(x):
            return x
        code = np.array(x.tolist(), np.int64)
        return pd.Series(list(c[np.arange(c.shape[0])[None, :], code].reshape(len(x), -1)))

    return vector(codes)


def _rows(base: DataFrame, k: int, seed: int) -> np.ndarray:
    """k distinct rows by the order of a hash of vec_id."""
    got = base.select("vec_id", "v", F.xxhash64("vec_id", F.lit(seed)).alias("h")).orderBy("h", "vec_id").limit(k).toPandas()
    if len(got) < k:
        raise ValueError(f"{k} clusters of {len(got)} rows")
    return np.array(got["v"].tolist(), np.float64)


#: Rounds of oversampling, each of which takes as many candidates as there are to be centroids.
OVERSAMPLING = 5


def _draws(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers in (0, 1] [row][sub-space] from a hash of each row."""
    x = h.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-53


def _race(sent, take: int):
    """A task's ``take`` first rows of each sub-space in a race: -ln(u) / squared distance to the nearest candidate."""

    def run(batches):
        import pyarrow as pa

        c = sent.value
        n, _, sd = c.shape
        score, ids, part = np.zeros((n, 0)), np.zeros((n, 0), np.int64), np.zeros((n, 0, sd))
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows_of(b, c)
            d = _codes(x, c)[1]
            with np.errstate(divide="ignore"):
                s = np.where(d > 0, -np.log(_draws(b.column("h").to_numpy(), n)) / d, np.inf).T
            score, ids, part = np.hstack((score, s)), np.hstack((ids, np.tile(b.column("vec_id").to_numpy(), (n, 1)))), np.concatenate((part, x.transpose(1, 0, 2)), axis=1)
            if score.shape[1] > take:
                first = np.argpartition(score, take - 1, axis=1)[:, :take]
                score, ids, part = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1), np.take_along_axis(part, first[:, :, None], 1)
        sq, at = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(sq.astype(np.int32)), pa.array(score[sq, at]), pa.array(ids[sq, at]), _lists(part[sq, at].reshape(-1, sd))], names=["sq", "score", "vec_id", "part"])

    return run


def _nearest_counts(sent):
    """How many of a task's rows each candidate is nearest to."""

    def run(batches):
        import pyarrow as pa

        c = sent.value
        n, k, _ = c.shape
        rows = np.zeros(n * k, np.int64)
        for b in batches:
            if b.num_rows:
                rows += np.bincount((_codes(_rows_of(b, c), c)[0] + np.arange(n) * k).ravel(), minlength=n * k)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at])], names=["at", "n"])

    return run


def _weighted_plus_plus(c: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on candidates c with weights w: k of them, or all that differ."""
    r = np.random.default_rng(seed)
    got = [int(np.argmax(w))]
    d = ((c - c[got[0]]) ** 2).sum(axis=1)
    while len(got) < k and (w * d).max() > 0:
        upto = np.cumsum(w * d)
        i = min(int(np.searchsorted(upto, r.random() * upto[-1], "right")), int(np.flatnonzero(w * d)[-1]))
        got.append(i)
        d = np.minimum(d, ((c - c[i]) ** 2).sum(axis=1))
    return c[got]


def spread(base: DataFrame, k: int, n: int, sub: int, seed: int = 1) -> np.ndarray:
    """Centroids to start from [sub-space][k][element] by oversampling (k-means||), for all sub-spaces of base (vec_id, v) at once.

    Each round takes about k rows of every sub-space as candidates, by exponential races whose chances grow with the squared
    distance to the candidates so far; then candidates are weighed by the rows they are nearest to and k of them
    are drawn by k-means++. That is a fixed number of passes for any k; the driver holds OVERSAMPLING * k candidates a
    sub-space. Where a sub-space has fewer than k distinct values, its first centroid fills the rest.
    """
    spark = base.sparkSession
    c = np.ascontiguousarray(_rows(base, 1, seed)[0][: n * sub].reshape(n, 1, sub))
    for t in range(OVERSAMPLING):
        rows = base.select("vec_id", "v", F.xxhash64("vec_id", F.lit(seed * 1000003 + t)).alias("h"))
        found = rows.mapInArrow(_race(spark.sparkContext.broadcast(c), k), "sq int, score double, vec_id long, part array<double>")
        at = F.row_number().over(Window.partitionBy("sq").orderBy("score", "vec_id"))
        got = found.withColumn("r", at).where(F.col("r") <= k).select("sq", "r", "part").toPandas().sort_values(["sq", "r"])
        if not len(got):
            break
        more = [np.array(g["part"].tolist(), np.float64) for _, g in got.groupby("sq")]
        at_sub = {int(s): x for s, x in zip(sorted(got["sq"].unique()), more, strict=True)}
        size = max(map(len, more))
        c = np.concatenate((c, np.stack([np.concatenate((x, np.tile(c[s, :1], (size - len(x), 1)))) for s in range(n) for x in [at_sub.get(s, c[s, :0])]])), axis=1)
    got = base.select("v").mapInArrow(_nearest_counts(spark.sparkContext.broadcast(c)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    w = np.zeros(c.shape[0] * c.shape[1])
    w[got["at"]] = got["n"]
    w = w.reshape(c.shape[:2])
    out = np.empty((n, k, sub))
    for s in range(n):
        x = _weighted_plus_plus(c[s], w[s], k, seed + s)
        out[s] = np.concatenate((x, np.tile(x[:1], (k - len(x), 1))))
    return out


def _plus_plus(base: DataFrame, k: int, seed: int) -> np.ndarray:
    width = base.select(F.size("v").alias("d")).first()
    c = spread(base, k, 1, width["d"], seed)[0] if width else np.zeros((0, 1))
    if len(np.unique(c, axis=0)) < k:
        raise ValueError(f"fewer than {k} distinct rows")
    return c


class Clustering:
    """k-means with fit, predict and transform. init: "random", "kmeans++" (by oversampling) or an array of centroids.

    Training uses all rows unless ``sample`` bounds them (chosen by hash).
    """

    def __init__(self, n_cluster: int, epochs: int = 10, init="random", seed: int = 1, sample: int | None = None, spherical: bool = False) -> None:
        if isinstance(init, str) and init not in ("random", "kmeans++"):
            raise ValueError(f"unknown init {init!r}")
        self.n_cluster, self.epochs, self.init, self.seed, self.sample, self.spherical = n_cluster, epochs, init, seed, sample, spherical
        self.centroids: np.ndarray | None = None

    def fit(self, base: DataFrame) -> Clustering:
        v = base.select("vec_id", V.doubles(F.col("embedding")).alias("v"))
        if self.sample:
            v = v.withColumn("h", F.xxhash64("vec_id", F.lit(self.seed))).orderBy("h").limit(self.sample).drop("h")
        c = np.asarray(self.init, np.float64) if not isinstance(self.init, str) else (_rows if self.init == "random" else _plus_plus)(v, self.n_cluster, self.seed)
        c = lloyd(v, c[None], self.epochs)[0]
        if self.spherical:
            size = np.sqrt((c * c).sum(axis=1, keepdims=True))
            c = np.divide(c, size, out=c.copy(), where=size > 0)
        self.centroids = c
        return self

    def _assigned(self, base: DataFrame) -> DataFrame:
        return assign(base.select("vec_id", V.doubles(F.col("embedding")).alias("v")), self.centroids[None])

    def predict(self, base: DataFrame) -> DataFrame:
        """vec_id, cid and dist to that centroid."""
        return self._assigned(base).select("vec_id", F.get("codes", F.lit(0)).alias("cid"), "dist")

    def transform(self, base: DataFrame) -> DataFrame:
        """vec_id and residual: the vector less its centroid."""
        return self._assigned(base).select("vec_id", "residual")

    def loss(self, base: DataFrame) -> DataFrame:
        return self.predict(base).agg(F.sum("dist").alias("loss"))


def pq_codebook(base: DataFrame, dim: int, sub: int = 4, k: int = 256, epochs: int = 10, seed: int = 1, start: np.ndarray | None = None) -> np.ndarray:
    """Codebook [sub-space][k][sub]; elements beyond the last whole sub-space are left out. With fewer rows than k, as
    many centroids as rows. start: rows whose parts are the first centroids, else they are spread by oversampling."""
    v = base.select("vec_id", V.sound(F.col("embedding"), dim).alias("v"))
    n = dim // sub
    if start is None:
        return lloyd(v, spread(v, min(k, base.count()), n, sub, seed), epochs)
    return lloyd(v, np.ascontiguousarray(start[:, : n * sub].reshape(len(start), n, sub).transpose(1, 0, 2)), epochs)


def _lookup(sent, kind: str):
    def run(batches):
        import pyarrow as pa

        c = sent.value
        n, k, sd = c.shape
        for b in batches:
            if not b.num_rows:
                continue
            x, d = _rows_of(b, c), np.zeros((b.num_rows, n, k))
            for j in range(sd):
                y, z = x[:, :, None, j], c[None, :, :, j]
                d += (y - z) * (y - z) if kind == "L2" else y * z
            q = np.repeat(b.column("q_id").to_numpy(), n * k)
            sq, code = np.divmod(np.tile(np.arange(n * k, dtype=np.int32), b.num_rows), np.int32(k))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(sq), pa.array(code), pa.array((d if kind == "L2" else -d).ravel())], names=["q_id", "sq", "k", "dist"])

    return run


def lookup_tables(queries: DataFrame, codebook: np.ndarray, metric: str = "L2") -> DataFrame:
    """(q_id, sq, k, dist): distance of each part of a query to each centroid of its sub-space."""
    V.metric(metric)
    sent = queries.sparkSession.sparkContext.broadcast(np.asarray(codebook, np.float64))
    return queries.select("q_id", V.doubles(F.col("embedding")).alias("v")).mapInArrow(_lookup(sent, metric.upper()), "q_id long, sq int, k int, dist double")
