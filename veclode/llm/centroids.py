"""Clustering of integer vectors around centroids by scalar lookup tables.

Vectors become small integers (floor of a scaled component). Within a round a block of vectors has few values in a dimension,
so the squared differences of a dimension are tabulated once for each value that occurs and each centroid, and a distance
is a sum of table entries that NumPy gathers: no difference and no product is computed for a vector. Tables belong to a
block of ``BLOCK`` vectors, so they have a bound whatever values there are.

Spark deals the vectors out; a task adds up what it assigned, at most a row a centroid, and one aggregation of these
integer sums gives the next centroids, the same for any order and number of tasks. What the driver holds is the centroids.

Cases: rows whose vector is null, of another length, or has a null, NaN or infinite component are left out; a null vec_id
is hashed as the empty string; rows that repeat a vec_id are vectors of their own, in the order of their components where
their hashes tie; with fewer vectors than centroids there are as many centroids as vectors; an empty centroid stays;
an empty table gives no rows; further columns are ignored. A component beyond 2**27 steps would overflow 64-bit distances and is
refused with an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Vectors that share tables, and the largest size of an integer component.
BLOCK, MOST = 4096, 1 << 27


def usable(v: Column, dim: int) -> Column:
    """Whether v has dim components, all of them finite numbers."""
    x = v.cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(good, F.lit(False))


def integers(base: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors of base (vec_id, embedding) with components floor(scale * x), written."""
    steps = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    rows = base.where(usable(F.col("embedding"), dim)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    far = F.exists(F.col("embedding").cast("array<double>"), lambda x: F.abs(x * scale) > MOST)
    fits = F.when(far, F.raise_error(F.lit(f"a component exceeds {MOST} steps")).cast("array<int>")).otherwise(steps.cast("array<int>"))
    return written(rows.select("vec_id", fits.alias("v")), "integers")


def first_centroids(rows: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    got = rows.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).toPandas()
    return np.array(got["v"].tolist(), np.int64)


def tabulated(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances [row][centroid] of integer rows, by a table of each dimension's occurring values."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for j in range(x.shape[1]):
        values, at = np.unique(x[:, j], return_inverse=True)
        d = values[:, None] - centroids[None, :, j]
        total += (d * d)[at]
    return total


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the lowest on ties) and its squared distance."""
    cluster, dist = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for s in range(0, len(x), BLOCK):
        d = tabulated(x[s : s + BLOCK], centroids)
        cluster[s : s + BLOCK] = d.argmin(axis=1)
        dist[s : s + BLOCK] = d.min(axis=1)
    return cluster, dist


def _rows(batch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _sums(sent):
    """What a task's vectors add up to: a row for each centroid that got one."""

    def run(batches):
        import pyarrow as pa

        c = sent.value
        total, n = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for b in batches:
            x = _rows(b, c.shape[1])
            cluster, _ = nearest(x, c)
            n += np.bincount(cluster, minlength=len(c))
            order = np.argsort(cluster, kind="stable")
            at, first = np.unique(cluster[order], return_index=True)
            if len(at):
                total[at] += np.add.reduceat(x[order], first, axis=0)
        at = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * c.shape[1]), pa.array(total[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), sums], names=["cluster", "n", "sums"])

    return run


def _assigned(sent):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            cluster, dist = nearest(_rows(b, sent.value.shape[1]), sent.value)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return run


def refined(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after rounds of assigning all vectors (vec_id, v) and taking the floor of each cluster's exact means."""
    dim = centroids.shape[1]
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(centroids)
        part = rows.select("v").mapInArrow(_sums(sent), "cluster int, n long, sums array<long>")
        got = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(dim)]).toPandas()
        centroids = centroids.copy()
        centroids[got["cluster"]] = got[[f"s{j}" for j in range(dim)]].to_numpy(np.int64) // got["n"].to_numpy(np.int64)[:, None]
    return centroids


def cluster(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of all vectors (vec_id, v)."""
    return rows.mapInArrow(_assigned(rows.sparkSession.sparkContext.broadcast(centroids)), "vec_id long, cluster int, distance long")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every usable vector, with the inertia of its cluster and of all and its centroid's digest.

    Cases: see the module. Results don't depend on the order of rows or the number of tasks.
    """
    rows = integers(table(spark, sf_dir, "embeddings"))
    start = first_centroids(rows, CENTROIDS)
    if not len(start):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    final = refined(rows, start, ROUNDS)
    found = written(cluster(rows, final), "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    about = [(k, s, sum(sums.values()), hashlib.sha256(",".join(map(str, final[k].tolist())).encode()).hexdigest()) for k, s in sorted(sums.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Rounds as CTEs: assignment by the least (distance, number), then the floor of sum / count."""
    out = [
        f"""k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cid, v AS c FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM k ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    dist = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for t in range(ROUNDS + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (SELECT r, vec_id, v, cid, {dist} AS d FROM k, c{t}) GROUP BY r)")
        if t < ROUNDS:
            mean = "(s - ((s % n) + n) % n) // n"
            out.append(f"m{t} AS (SELECT cid, list({mean} ORDER BY p) AS c FROM (SELECT cid, p, sum(v[p])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cid, v, unnest(range(1, {DIM + 1})) AS p FROM a{t}) GROUP BY cid, p) GROUP BY cid)")
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT o.cid, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN m{t} m USING (cid))")
    last = f"a{ROUNDS}"
    return f"""WITH {', '.join(out)}
SELECT vec_id, cid AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cid))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{ROUNDS} USING (cid)"""


OP11_SQL = _sql()
