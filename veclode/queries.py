"""Registered queries on ``embeddings``, and the same in DuckDB SQL. A search takes every row whose id is divisible
by 20 as a query, against all rows, without itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import codes, kmeans, knn
from .operators import quantizers as Q
from .plans.scratch import written

K, CLUSTERS, EPOCHS = 10, 10, 10
#: A product quantizer's elements a sub-space, centroids in each, rounds.
SUB, CODES, PQ_EPOCHS = 4, 256, 10
#: Candidates for each neighbour from which product codes come to a recall of 0.9.
WIDE = 6.0


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def query_rows(b: DataFrame) -> DataFrame:
    return b.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


def scaled(b: DataFrame) -> DataFrame:
    """Rows of different lengths, so that metrics rank differently."""
    return b.select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 7 + 1)).alias("embedding"))


def first_rows(b: DataFrame, n: int) -> np.ndarray:
    """Centroids to start from: the n rows with the smallest ids."""
    return np.array(b.orderBy("vec_id").limit(n).select(V.doubles(F.col("embedding")).alias("v")).toPandas()["v"].tolist(), np.float64)


# --- SQL pieces -----------------------------------------------------------------------------------------------------

def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def sql_ip(a: str, b: str) -> str:
    return f"(-list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])))"


SQL = {"L2": sql_l2, "IP": sql_ip}
E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
SCALED = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7 + 1)) AS v FROM embeddings)"
UNIT = "u AS (SELECT vec_id, list_transform(v, lambda x: x / s) AS v FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM e))"


def sql_knn(ctes: list[str], q: str, b: str, kind: str, k: int = K, dist: str | None = None) -> str:
    d = dist or SQL[kind]("q.v", "b.v")
    return f"""WITH {', '.join(ctes)}, d AS (SELECT q.vec_id AS q_id, b.vec_id, {d} AS dist FROM {q} q, {b} b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id))::INT AS rank, vec_id, dist FROM d)
SELECT * FROM r WHERE rank <= {k}"""


FLAT = "x AS (SELECT vec_id, (i - 1)::INT AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM e))"


def sql_global(name: str, metric: str) -> str:
    """CTEs x and p(lo, hi): the calibration of a quantizer with one range."""
    _, drop, ratio = Q.GLOBAL[name]
    f32 = lambda n, r: f"floor(({n})::FLOAT * {r}::FLOAT)::BIGINT"
    if name == "SQ8U" and metric == "IP":
        return f"{FLAT}, p AS (SELECT 0.0::DOUBLE AS lo, max(abs(x)) AS hi FROM x)"
    n = "(SELECT count(*) FROM x)"
    take = f32(n, ratio) if ratio < 1 else n
    return f"""{FLAT}, o AS (SELECT x, row_number() OVER (ORDER BY vec_id, pos) AS nr FROM x), t AS (SELECT x FROM o WHERE nr <= {take}),
s AS (SELECT x, row_number() OVER (ORDER BY x) AS a, row_number() OVER (ORDER BY x DESC) AS b FROM t), top AS (SELECT {f32('(SELECT count(*) FROM t)', drop)} + 1 AS n),
p AS (SELECT max(x) FILTER (a <= n) AS lo, min(x) FILTER (b <= n) AS hi FROM s, top)"""


def sql_per_dim(name: str, chunk: bool = False) -> str:
    """CTEs x and w(pos, lo, hi) and p(los, his)."""
    top = f"(floor((SELECT count(*) FROM e)::FLOAT * {Q.PER_DIM[name][1]}::FLOAT)::BIGINT + 1)"
    pos = "((vec_id * 64 + pos) // (SELECT count(*) FROM e))::INT" if chunk else "pos"
    return f"""{FLAT}, y AS (SELECT {pos} AS pos, x FROM x), s AS (SELECT pos, x, row_number() OVER (PARTITION BY pos ORDER BY x) AS a, row_number() OVER (PARTITION BY pos ORDER BY x DESC) AS b FROM y),
w AS (SELECT pos, max(x) FILTER (a <= {top}) AS lo, min(x) FILTER (b <= {top}) AS hi FROM s GROUP BY pos), p AS (SELECT list(lo ORDER BY pos) AS los, list(hi - lo ORDER BY pos) AS difs FROM w)"""


def _ratio(x: str, lo: str, dif: str) -> str:
    return f"least(greatest(CASE WHEN {dif} = 0 THEN 0 ELSE ({x} - {lo}) / {dif} END, 0), 1)"


FP16 = "CASE WHEN abs(X) < 0.00006103515625 THEN round_even(X * 16777216, 0) / 16777216 ELSE X * 4398046511105 - (X * 4398046511105 - X) END"
BF16 = "X * 35184372088833 - (X * 35184372088833 - X)"
E5M2 = "CASE WHEN h = 0 THEN 0 ELSE sign(h) * floor(abs(h) / pow(2.0, greatest(floor(log2(abs(h))), -14) - 2)) * pow(2.0, greatest(floor(log2(abs(h))), -14) - 2) END"


def sql_codes(name: str, metric: str = "L2") -> list[str]:
    """CTEs up to c(vec_id, v, code)."""
    each = lambda f: f"c AS (SELECT vec_id, v, list_transform(v, lambda x: {f}) AS code FROM e)"
    if name == "FP32":
        return [each("x")]
    if name in ("FP16", "BF16"):
        return [each((FP16 if name == "FP16" else BF16).replace("X", "x"))]
    if name == "E5M2":
        return [
            "g AS (SELECT vec_id, v, list_transform(v, lambda x: " + FP16.replace("X", "x") + ") AS g FROM e)", "c AS (SELECT vec_id, v, list_transform(g, lambda h: " + E5M2 + ") AS code FROM g)"]
    if name == "SQ1":
        return [each("(x > 0)::INT")]
    if name == "SQ8P":
        return ["c AS (SELECT vec_id, v, m, list_transform(v, lambda x: trunc(CASE WHEN m > 0 THEN x / m * 127 ELSE 0 END)::INT) AS code FROM (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS m FROM e))"]
    if name in Q.GLOBAL:
        mul = Q.GLOBAL[name][0]
        f = f"(sign(x) * floor(least(abs(x) / hi, 1) * {mul} + 0.5))::INT" if name == "SQ8U" and metric == "IP" else f"floor({_ratio('x', 'lo', '(hi - lo)')} * {mul} + 0.5)::INT"
        return [sql_global(name, metric), f"c AS (SELECT vec_id, v, list_transform(v, lambda x: {f}) AS code FROM e, p)"]
    mul = Q.PER_DIM[name][0]
    return [sql_per_dim(name), f"c AS (SELECT vec_id, v, list_transform(list_zip(v, los, difs), lambda z: floor({_ratio('z[1]', 'z[2]', 'z[3]')} * {mul} + 0.5)::INT) AS code FROM e, p)"]


def sql_vectors(name: str, metric: str = "L2") -> list[str]:
    """CTEs qv and bv (vec_id, v): what queries and codes are compared as."""
    l2 = metric == "L2"
    as_codes = "SELECT vec_id, list_transform(code, lambda x: x::DOUBLE) AS v FROM c"
    as_rows = "SELECT vec_id, v FROM e"
    times = lambda s: f"SELECT vec_id, list_transform(v, lambda x: x * {s}) AS v FROM e"
    dims = lambda f: f"SELECT vec_id, list_transform(list_zip(code, los, difs), lambda z: {f}) AS v FROM c, p"
    q, b = {
        "SQ8": (times("256.0" if l2 else "1.0"), dims("(z[1] + 0.5) * z[3] + 256.0 * z[2]")),
        "SQ4": (times("16.0" if l2 else "1.0"), dims("(z[1] + 0.5) * z[3] + 16.0 * z[2]" if l2 else "(z[1] + 0.5) / 16.0 * z[3] + z[2]")),
        "SQ6": (as_rows, dims("(z[1] + 0.5) / 63.0 * z[3] + z[2]")),
        "SQ4UA": (f"SELECT vec_id, list_transform(v, lambda x: floor({_ratio('x', 'lo', '(hi - lo)')} * 127 + 0.5)) AS v FROM e, p", "SELECT vec_id, list_transform(code, lambda x: (8 * x + 4)::DOUBLE) AS v FROM c"),
    }.get(name, (as_rows if name in Q.GRIDS else as_codes, as_codes))
    if name == "SQ8P":
        q = f"SELECT vec_id, list_append(list_transform(code, lambda x: x::DOUBLE * m{' * 2.0' if l2 else ''}), {'1.0' if l2 else '0.0'}) AS v FROM c"
        m = BF16.replace("X", "m")
        n = BF16.replace("X", "n")
        b = f"SELECT vec_id, list_append(list_transform(code, lambda x: x::DOUBLE * ({m}) / 127.0 / 127.0), {f'-({n})' if l2 else '0.0'}) AS v FROM (SELECT *, list_sum(list_transform(v, lambda x: x * x)) AS n FROM c)"
    return [f"qv AS ({q})", f"bv AS ({b})"]


def sql_flat(name: str, metric: str, k: int = K) -> str:
    kind = "IP" if name == "SQ8P" else "L2" if name in ("SQ4U", "SQ4UA", "SQ2U", "SQ1") else metric
    return sql_knn([E, *sql_codes(name, metric), *sql_vectors(name, metric)], "qv", "bv", kind, k)


def sql_two_stage(name: str, metric: str) -> str:
    return sql_refined(sql_flat(name, metric, int(K * Q.FACTOR[name])), metric)


def sql_refined(inner: str, metric: str) -> str:
    """Candidates of another query, ranked by exact distances."""
    return f"""WITH f AS ({inner}), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT f.q_id, f.vec_id, {SQL[metric]('a.v', 'b.v')} AS dist FROM f JOIN e a ON a.vec_id = f.q_id JOIN e b ON b.vec_id = f.vec_id),
r AS (SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id))::INT AS rank, vec_id, dist FROM d) SELECT * FROM r WHERE rank <= {K}"""


#: The grid of sums: steps to one, by the largest value and the number of rows.
GRID = "grid AS (SELECT pow(2.0::DOUBLE, 61 - ceil(log2(max(list_max(list_transform(v, lambda x: abs(x)))))) - ceil(log2(count(*)))) AS u FROM e)"


def sql_lloyd(start: str, ctes: list[str], epochs: int) -> tuple[list[str], str]:
    """CTEs a rounds of k-means on part(vec_id, sq, s) from centroids m0(sq, cid, c), and the name of the last."""
    out, m = [*ctes, GRID, start], "m0"
    for t in range(1, epochs + 1):
        out += [
            f"a{t} AS MATERIALIZED (SELECT vec_id, sq, s, arg_min(cid, (d, cid)) AS cid FROM (SELECT part.*, cid, {sql_l2('s', 'c')} AS d FROM part JOIN {m} USING (sq)) GROUP BY vec_id, sq, s)",
            f"g{t} AS (SELECT sq, cid, j, sum(floor(s[j] * u + 0.5)::BIGINT)::DOUBLE / any_value(u) / count(*)::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM a{t}), grid GROUP BY sq, cid, j)",
            f"m{t} AS MATERIALIZED (SELECT m0.sq, m0.cid, coalesce(n.c, list_transform(m0.c, lambda x: 0.0::DOUBLE)) AS c FROM m0 LEFT JOIN (SELECT sq, cid, list(x ORDER BY j) AS c FROM g{t} GROUP BY sq, cid) n ON n.sq = m0.sq AND n.cid = m0.cid)",
        ]
        m = f"m{t}"
    return out, m


def sql_kmeans() -> tuple[list[str], str]:
    return sql_lloyd(f"m0 AS (SELECT 0 AS sq, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cid, v AS c FROM e ORDER BY vec_id LIMIT {CLUSTERS})", [E, "part AS (SELECT vec_id, 0 AS sq, v AS s FROM e)"], EPOCHS)


def sql_pq() -> tuple[list[str], str]:
    part = f"part AS (SELECT vec_id, sq::INT AS sq, v[sq * {SUB} + 1:sq * {SUB} + {SUB}] AS s FROM (SELECT *, unnest(range(0, len(v) // {SUB})) AS sq FROM e))"
    return sql_lloyd(f"m0 AS (SELECT sq, (row_number() OVER (PARTITION BY sq ORDER BY vec_id) - 1)::INT AS cid, s AS c FROM part QUALIFY row_number() OVER (PARTITION BY sq ORDER BY vec_id) <= {CODES})", [E, part], PQ_EPOCHS)


# --- queries --------------------------------------------------------------------------------------------------------

def _clustering(b: DataFrame) -> kmeans.Clustering:
    return kmeans.Clustering(CLUSTERS, EPOCHS, first_rows(b, CLUSTERS)).fit(b)


def _codebook(b: DataFrame) -> np.ndarray:
    rows = first_rows(b, CODES)
    return kmeans.pq_codebook(b, rows.shape[1], SUB, CODES, PQ_EPOCHS, start=rows)


def _centroid_rows(spark: SparkSession, c: np.ndarray) -> DataFrame:
    """(sq, cid, centroid): as many rows as the parameters say."""
    return spark.createDataFrame([(s, k, [float(x) for x in v]) for s, book in enumerate(c) for k, v in enumerate(book)], "sq int, cid int, centroid array<double>")


def _stored_bytes(b: DataFrame) -> DataFrame:
    """Bytes of a stored code, and how many rows have one."""
    out = None
    for name in ("FP16", "SQ8U", "SQ6", "SQ4U", "SQ2U", "SQ1"):
        rows = codes.stored(b, Q.fit(name, b, "IP" if name == "SQ1" else "L2")).groupBy(F.octet_length("code").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("quantizer"), "bytes", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def entries() -> dict[str, Entry]:
    """name -> query and its SQL."""
    out: dict[str, Entry] = {}

    def add(name: str, f, sql: str | None = None) -> None:
        out[name] = ((lambda spark, sf_dir, f=f: f(base(spark, sf_dir))), sql)

    v = lambda: V.doubles(F.col("embedding"))  # noqa: E731  made when a session is there
    for m in ("L2", "IP"):
        add(f"knn_{m.lower()}", lambda b, m=m: knn.exact(query_rows(b), b, K, m, others=True), sql_knn([E], "e", "e", m))
        add(f"knn_{m.lower()}_scaled", lambda b, m=m: knn.exact(query_rows(scaled(b)), scaled(b), K, m, others=True), sql_knn([SCALED], "e", "e", m))

    def cosine(b):
        u = scaled(b).select("vec_id", V.normalize(F.col("embedding")).alias("embedding"))
        return knn.exact(query_rows(u), u, K, "IP", others=True)

    add("knn_cosine", cosine, sql_knn([SCALED, UNIT], "u", "u", "IP"))
    add("normalize", lambda b: scaled(b).select("vec_id", V.normalize(F.col("embedding")).alias("unit")), f"WITH {SCALED}, {UNIT} SELECT vec_id, v AS unit FROM u")
    add("row_distances", lambda b: b.alias("a").join(b.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("vec_id"), V.l2(V.doubles(F.col("a.embedding")), V.doubles(F.col("b.embedding"))).alias("l2"), V.ip(V.doubles(F.col("a.embedding")), V.doubles(F.col("b.embedding"))).alias("ip")),
        f"WITH {E} SELECT a.vec_id, {sql_l2('a.v', 'b.v')} AS l2, {sql_ip('a.v', 'b.v')} AS ip FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")

    def recall_of(b, name="SQ4U"):
        q = query_rows(b)
        return knn.recall(knn.flat(q, b, K, Q.fit(name, b), others=True), knn.exact(q, b, K, others=True), K)

    add("recall_at_k", recall_of, f"""WITH f AS ({sql_flat('SQ4U', 'L2')}), t AS ({sql_knn([E], 'e', 'e', 'L2')})
SELECT count(*) AS hits, (SELECT count(DISTINCT q_id) FROM t) AS n_queries, count(*) / ((SELECT count(DISTINCT q_id) FROM t) * {K})::DOUBLE AS recall FROM f JOIN t USING (q_id, vec_id)""")

    for name in Q.GLOBAL:
        for m in ("L2", "IP") if name == "SQ8U" else ("L2",):
            def calib(b, name=name, m=m):
                z = Q.fit(name, b, m)
                return b.limit(1).select(F.lit(name).alias("quantizer"), F.lit(z.lo).alias("lo"), F.lit(z.lo + z.dif if not (name == "SQ8U" and m == "IP") else z.dif).alias("hi"))

            add(f"calib_{name.lower()}_{m.lower()}", calib, f"WITH {E}, {sql_global(name, m)} SELECT '{name}' AS quantizer, lo, lo + (hi - lo) AS hi FROM p")
    for name, (_, drop) in Q.PER_DIM.items():
        for chunk in (False, True):
            def limits(b, drop=drop, chunk=chunk):
                n, d = b.count(), b.select(F.size("embedding")).first()[0]
                got = Q.per_dim_limits(b, Q.trim_rank(n, drop), d, n if chunk else 0)
                return b.sparkSession.createDataFrame([(p, *x) for p, x in sorted(got.items())], "pos int, lo double, hi double")  # a row a dimension

            add(f"calib_{'chunk' if chunk else 'perdim'}_{name.lower()}", limits, f"WITH {E}, {sql_per_dim(name, chunk)} SELECT pos, lo, hi FROM w")

    for name in Q.NAMES:
        if name == "PQ8":
            continue
        m = "IP" if name == "SQ1" else "L2"
        add(f"encode_{name.lower()}", lambda b, name=name, m=m: b.select("vec_id", Q.fit(name, b, m).encode(v()).alias("code")), f"WITH {', '.join([E, *sql_codes(name, m)])} SELECT vec_id, code FROM c")
        for m in ("IP",) if name == "SQ1" else ("L2", "IP"):
            add(f"flat_{name.lower()}_{m.lower()}", lambda b, name=name, m=m: knn.flat(query_rows(b), b, K, Q.fit(name, b, m), others=True), sql_flat(name, m))
            if name in Q.FACTOR:
                add(f"refine_{name.lower()}_{m.lower()}", lambda b, name=name, m=m: knn.two_stage(query_rows(b), b, K, m, Q.fit(name, b, m), others=True), sql_two_stage(name, m))
    add("encode_sq8u_ip", lambda b: b.select("vec_id", Q.fit("SQ8U", b, "IP").encode(v()).alias("code")), f"WITH {', '.join([E, *sql_codes('SQ8U', 'IP')])} SELECT vec_id, code FROM c")
    for name, f in (("SQ8U", "x / 127.0 * (hi - lo) + lo"), ("SQ4U", "x / 15.0 * (hi - lo) + lo"), ("SQ2U", "x / 3.0 * (hi - lo) + lo")):
        def decode(b, name=name):
            z = Q.fit(name, b)
            return b.select("vec_id", z.encode(v()).alias("c")).select("vec_id", z.decode(F.col("c")).alias("decoded"))

        add(f"decode_{name.lower()}", decode, f"WITH {', '.join([E, *sql_codes(name)])} SELECT vec_id, list_transform(code, lambda x: {f}) AS decoded FROM c, p")
    for name in ("SQ8", "SQ4", "SQ6"):
        def decode_dim(b, name=name):
            z = Q.fit(name, b)
            return b.select("vec_id", z.encode(v()).alias("c")).select("vec_id", z.decode(F.col("c")).alias("decoded"))

        add(f"decode_{name.lower()}", decode_dim, f"WITH {', '.join([E, *sql_codes(name)])} SELECT vec_id, list_transform(list_zip(code, los, difs), lambda z: z[1] / {float(Q.PER_DIM[name][0])} * z[3] + z[2]) AS decoded FROM c, p")
    add("stored_bytes", _stored_bytes, "SELECT * FROM (VALUES ('FP16', 2 * 64), ('SQ8U', 64), ('SQ6', 48), ('SQ4U', 32), ('SQ2U', 16), ('SQ1', 8)) t(quantizer, bytes), (SELECT count(*) AS n FROM embeddings)")
    for name, bits in Q.BITS.items():
        m, unit, per = ("IP" if name == "SQ1" else "L2"), *((3, 4) if bits == 6 else (1, 8 // bits))
        add(f"pack_{name.lower()}", lambda b, name=name, m=m, bits=bits: b.select("vec_id", V.packed(Q.fit(name, b, m).encode(v()), bits).alias("bytes")),
            f"WITH {', '.join([E, *sql_codes(name, m)])} SELECT vec_id, list_transform(range(0, len(code) // {per} * {unit}), lambda b: ((list_sum(list_transform(range(0, {per}), lambda k: code[(b // {unit}) * {per} + k + 1]::BIGINT << (k * {bits})))::BIGINT >> ((b % {unit}) * 8)) % 256)::INT) AS bytes FROM c")

    ctes, m = sql_kmeans()
    km = f"WITH {', '.join(ctes)}"
    assigned = f", z AS (SELECT vec_id, s AS v, arg_min(cid, (d, cid)) AS cid, min(d) AS dist FROM (SELECT part.*, cid, {sql_l2('s', 'c')} AS d FROM part JOIN {m} USING (sq)) GROUP BY vec_id, s)"
    add("kmeans_fit", lambda b: _centroid_rows(b.sparkSession, _clustering(b).centroids[None]).select("cid", "centroid"), f"{km} SELECT cid, c AS centroid FROM {m}")
    add("kmeans_predict", lambda b: _clustering(b).predict(b), f"{km}{assigned} SELECT vec_id, cid, dist FROM z")
    add("kmeans_residual", lambda b: _clustering(b).transform(b), f"{km}{assigned} SELECT vec_id, list_transform(list_zip(z.v, {m}.c), lambda y: y[1] - y[2]) AS residual FROM z JOIN {m} USING (cid)")
    add("kmeans_sizes", lambda b: _clustering(b).predict(b).groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")), f"{km}{assigned} SELECT cid, count(*) AS n, max(dist) AS radius FROM z GROUP BY cid")
    ctes, m = sql_pq()
    pq = f"WITH {', '.join(ctes)}"
    coded = f", z AS (SELECT vec_id, sq, arg_min(cid, (d, cid)) AS cid FROM (SELECT part.*, cid, {sql_l2('s', 'c')} AS d FROM part JOIN {m} USING (sq)) GROUP BY vec_id, sq)"
    add("pq_codebook", lambda b: _centroid_rows(b.sparkSession, _codebook(b)), f"{pq} SELECT sq, cid, c AS centroid FROM {m}")
    add("pq_encode", lambda b: b.select("vec_id", Q.fit("PQ8", b, codebook=_codebook(b)).encode(v()).alias("code")), f"{pq}{coded} SELECT vec_id, list(cid ORDER BY sq) AS code FROM z GROUP BY vec_id")
    add("pq_lookup", lambda b: kmeans.lookup_tables(query_rows(b), _codebook(b)), f"{pq} SELECT part.vec_id AS q_id, part.sq, cid AS k, {sql_l2('s', 'c')} AS dist FROM part JOIN {m} USING (sq) WHERE part.vec_id % 20 = 0")
    for mm in ("L2", "IP"):
        add(f"pq_adc_{mm.lower()}", lambda b, mm=mm: knn.flat(query_rows(b), b, K, Q.fit("PQ8", b, mm, codebook=_codebook(b)), others=True),
            sql_knn([*ctes, coded[2:], f"bv AS (SELECT vec_id, flatten(list(c ORDER BY z.sq)) AS v FROM z JOIN {m} ON {m}.sq = z.sq AND {m}.cid = z.cid GROUP BY vec_id)"], "e", "bv", mm))

    def pq_recall(b):
        """Recall of the product quantizer's own ranking, of its candidates re-ranked, and of more of them; the codebook starts
        from oversampled candidates."""
        z, q = Q.fit("PQ8", b), query_rows(b)
        truth = written(knn.exact(q, b, K, others=True), "truth")
        stored = written(codes.stored(b, z), "codes")
        out = knn.recall(knn.flat_codes(q, stored, K, z, others=True), truth, K).withColumn("stage", F.lit("flat"))
        for stage, f in (("refined", z.factor), ("wide", WIDE)):
            found = knn.refine(knn.flat_codes(q, stored, int(K * f), z, others=True), q, b, K)
            out = out.unionByName(knn.recall(found, truth, K).withColumn("stage", F.lit(stage)))
        return out

    for name, f in (("refine_pq8_l2", Q.FACTOR["PQ8"]), ("refine_pq8_wide_l2", WIDE)):
        inner = sql_knn([*ctes, coded[2:], f"bv AS (SELECT vec_id, flatten(list(c ORDER BY z.sq)) AS v FROM z JOIN {m} ON {m}.sq = z.sq AND {m}.cid = z.cid GROUP BY vec_id)"], "e", "bv", "L2", int(K * f))
        add(name, lambda b, f=f: knn.two_stage(query_rows(b), b, K, "L2", Q.fit("PQ8", b, codebook=_codebook(b)), others=True, factor=f), sql_refined(inner, "L2"))
    add("pq_recall", pq_recall, None)

    def stored(b):
        """The rows as a named data set in a folder: base, queries and the true neighbours."""
        from .plans.scratch import scratch_dir
        from .sources import datasets

        folder = f"{scratch_dir(b.sparkSession)}/veclode/sets-{uuid.uuid4().hex}"
        rows = datasets.validated(scaled(b))
        rows.write.parquet(f"{folder}/lastfm-64-dot/base")
        query_rows(rows).write.parquet(f"{folder}/lastfm-64-dot/queries")
        d = datasets.dataset(b.sparkSession, "lastfm-64-dot", folder)
        knn.exact(d.get_queries(), d.get_database(), 2 * K, d.metric, others=True).write.parquet(f"{folder}/lastfm-64-dot/truth")
        return d

    add("dataset_database", lambda b: stored(b).get_database().select("vec_id", F.col("embedding").alias("unit")), f"WITH {SCALED}, {UNIT} SELECT vec_id, v AS unit FROM u")
    add("dataset_groundtruth", lambda b: stored(b).get_groundtruth(K), sql_knn([SCALED, UNIT], "u", "u", "IP"))

    from .operators import graph_queries

    for name, f, sql in graph_queries.entries():
        add(name, f, sql)
    return out
