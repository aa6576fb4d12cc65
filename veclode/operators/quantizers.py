"""Quantizers: fit gives a few numbers, encode and decode are projections, distances are those of two code vectors.

Every quantizer states its distance as squared L2 or negated dot product of a vector made from the query and one made
from a code, on the quantizer's own scale, so one search serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.order import kth_smallest, trimmed, trimmed_by

#: Candidates fetched for each neighbour before re-ranking.
FACTOR = {"SQ8U": 1.5, "SQ8": 1.5, "SQ8P": 1.5, "SQ4U": 1.5, "SQ4UA": 1.5, "PQ8": 1.5, "SQ2U": 3.0, "SQ1": 3.0}
ALIASES = {"FP8_E5M2": "E5M2", "BINARYQUANT": "SQ1"}
#: Steps of the code, share of elements dropped at either end, share of elements trained on.
GLOBAL = {"SQ8U": (127, 0.0, 1.0), "SQ4U": (15, 0.01, 0.1), "SQ4UA": (15, 0.01, 1.0), "SQ2U": (3, 0.05, 0.1)}
PER_DIM = {"SQ8": (255, 0.0), "SQ6": (63, 0.01), "SQ4": (15, 0.01)}
GRIDS = {"FP32": lambda x: x, "FP16": V.fp16, "BF16": V.bf16, "E5M2": V.e5m2}
REFINERS = ("FP32", "FP16", "SQ8", "SQ8U")
#: Bits of a packed code, and quantizers with a distance between two codes (used to build graphs).
BITS = {"SQ6": 6, "SQ4": 4, "SQ4U": 4, "SQ4UA": 4, "SQ2U": 2, "SQ1": 1}
SYMMETRIC = ("FP32", "FP16", "BF16", "SQ8U", "SQ4U", "SQ2U", "SQ1")
NAMES = (*GRIDS, *PER_DIM, *GLOBAL, "SQ8P", "SQ1", "PQ8")


def trim_rank(n: int, ratio: float) -> int:
    """int(n * ratio) + 1 with the product in single precision."""
    return int(np.float32(n) * np.float32(ratio)) + 1


def elements(df: DataFrame, dim: int = 0) -> DataFrame:
    """A row an element: vec_id, pos, x. dim: another length, or an element that isn't finite, is an error."""
    v = F.col("embedding")
    return df.select("vec_id", F.posexplode(V.sound(v, dim) if dim else V.doubles(v)).alias("pos", "x"))


def _prefix(df: DataFrame, dim: int, ratio: float) -> tuple[DataFrame, int]:
    """Elements of the first share of the flat data in the order of vec_id, and how many they are."""
    n = df.count()
    take = int(np.float32(n * dim) * np.float32(ratio)) if ratio < 1 else n * dim
    if take >= n * dim:
        return elements(df, dim), n * dim
    rows, rest = divmod(take, dim)
    last = kth_smallest(df, "vec_id", rows + 1)
    e = elements(df.where(F.col("vec_id") <= last), dim)
    return e.where((F.col("vec_id") < last) | (F.col("pos") < rest)), take


def _rounded(t: Column, mul: int) -> Column:
    """round(clamp(t) * mul), halves up; what isn't a number (an empty range) is 0."""
    t = F.when(F.isnan(t), F.lit(0.0)).otherwise(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))
    return F.floor(t * mul + 0.5).cast("int")


def _ratio(x: Column, lo: Column | float, dif: Column | float) -> Column:
    dif = dif if isinstance(dif, Column) else F.lit(float(dif))
    return F.when(dif == 0, F.lit(0.0)).otherwise((x - lo) / F.when(dif == 0, F.lit(1.0)).otherwise(dif))


@dataclass
class Quantizer:
    """A fitted quantizer; make one with :func:`fit`."""

    name: str
    metric: str
    dim: int
    lo: float = 0.0
    dif: float = 0.0
    los: list[float] = field(default_factory=list)
    difs: list[float] = field(default_factory=list)
    codebook: np.ndarray | None = None

    @property
    def factor(self) -> float:
        return FACTOR.get(self.name, 1.0)

    def _dims(self, values: list[float]) -> Column:
        return F.lit([float(x) for x in values])

    def _affine(self, v: Column, mul: int) -> Column:
        if self.name == "SQ8U" and self.metric == "IP":
            return F.transform(v, lambda x: F.when(F.lit(self.dif) == 0, F.lit(0)).otherwise(F.signum(x) * F.floor(F.least(F.abs(x) / (self.dif or 1.0), F.lit(1.0)) * mul + 0.5)).cast("int"))
        return F.transform(v, lambda x: _rounded(_ratio(x, self.lo, self.dif), mul))

    def encode(self, v: Column) -> Column:
        """Codes of a vector of doubles: numbers on the grid for reduced precision, else integers."""
        n = self.name
        if n in GRIDS:
            return F.transform(v, GRIDS[n])
        if n in GLOBAL:
            return self._affine(v, GLOBAL[n][0])
        if n in PER_DIM:
            z = F.arrays_zip(v.alias("x"), self._dims(self.los).alias("lo"), self._dims(self.difs).alias("dif"))
            return F.transform(z, lambda t: _rounded(_ratio(t["x"], t["lo"], t["dif"]), PER_DIM[n][0]))
        if n == "SQ1":
            return F.transform(v, lambda x: (x > 0).cast("int"))
        if n == "SQ8P":  # cut, not rounded; scaled by the row's largest size
            m = F.array_max(F.transform(v, F.abs))
            return F.transform(v, lambda x: F.when(m > 0, x / F.when(m > 0, m).otherwise(1.0) * 127).otherwise(0.0).cast("int"))
        if n == "PQ8":
            from .kmeans import nearest

            return nearest(v, self.codebook)
        raise ValueError(n)

    def decode(self, c: Column) -> Column:
        """A vector for a code (float division, so every code has its own value)."""
        n = self.name
        if n in GRIDS:
            return c
        if n == "SQ8U" and self.metric == "IP":
            return F.transform(c, lambda x: x / F.lit(127.0) * self.dif)
        if n in GLOBAL:
            return F.transform(c, lambda x: x / F.lit(float(GLOBAL[n][0])) * self.dif + self.lo)
        if n in PER_DIM:
            z = F.arrays_zip(c.alias("x"), self._dims(self.los).alias("lo"), self._dims(self.difs).alias("dif"))
            return F.transform(z, lambda t: t["x"] / F.lit(float(PER_DIM[n][0])) * t["dif"] + t["lo"])
        if n == "PQ8":
            return self._reconstructed(c)
        raise ValueError(f"{n} codes hold no scale to decode by")

    def _reconstructed(self, c: Column) -> Column:
        from .kmeans import reconstructed

        return reconstructed(c, self.codebook)

    def query_vector(self, v: Column) -> Column:
        """What a query is compared as."""
        n, l2 = self.name, self.metric == "L2"
        if n in GRIDS:
            return v
        if n in ("SQ8", "SQ4"):
            scale = {("SQ8", True): 256.0, ("SQ8", False): 1.0, ("SQ4", True): 16.0, ("SQ4", False): 1.0}[n, l2]
            return F.transform(v, lambda x: x * scale)
        if n == "SQ6":
            return v
        if n == "SQ4UA":
            return F.transform(self._affine(v, 127), lambda x: x.cast("double"))
        if n == "PQ8":
            return F.slice(v, 1, int(self.codebook.shape[0] * self.codebook.shape[2]))
        if n == "SQ8P":
            m = F.array_max(F.transform(v, F.abs))
            return F.transform(self.encode(v), lambda x: x.cast("double") * m)
        return F.transform(self.encode(v), lambda x: x.cast("double"))

    def code_vector(self, c: Column, v: Column | None = None) -> Column:
        """What a code is compared as; SQ8P also needs the vector, for its scale (kept in bf16)."""
        n, l2 = self.name, self.metric == "L2"
        if n in GRIDS:
            return c
        if n in PER_DIM:
            z = F.arrays_zip(c.alias("x"), self._dims(self.los).alias("lo"), self._dims(self.difs).alias("dif"))
            if n == "SQ6":
                return F.transform(z, lambda t: (t["x"] + 0.5) / 63.0 * t["dif"] + t["lo"])
            if n == "SQ8":
                return F.transform(z, lambda t: (t["x"] + 0.5) * t["dif"] + 256.0 * t["lo"])
            if l2:
                return F.transform(z, lambda t: (t["x"] + 0.5) * t["dif"] + 16.0 * t["lo"])
            return F.transform(z, lambda t: (t["x"] + 0.5) / 16.0 * t["dif"] + t["lo"])
        if n == "SQ4UA":
            return F.transform(c, lambda x: (8 * x + 4).cast("double"))
        if n == "PQ8":
            return self._reconstructed(c)
        if n == "SQ8P":
            m = V.bf16(F.array_max(F.transform(v, F.abs)))
            return F.transform(c, lambda x: x.cast("double") * m / 127.0 / 127.0)
        return F.transform(c, lambda x: x.cast("double"))

    @property
    def kind(self) -> str:
        """The distance of query and code vectors: the uniform 4- and 2-bit codes and sign bits use L2 under any metric
        (right for normalised data only)."""
        return "L2" if self.name in ("SQ4U", "SQ4UA", "SQ2U", "SQ1") else self.metric

    def bias(self, v: Column) -> Column | None:
        """A term of the distance that only the base vector gives: (distance = bias + scale * dot)."""
        if self.name == "SQ8P" and self.metric == "L2":
            return V.bf16(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return None


def known(name: str) -> str:
    n = ALIASES.get(name.upper(), name.upper())
    if n not in NAMES:
        raise ValueError(f"unknown quantizer {name!r}; known: {', '.join(NAMES)}")
    return n


def fit(name: str, base: DataFrame, metric: str = "L2", calibration: str = "per_dim", codebook: np.ndarray | None = None) -> Quantizer:
    """Calibrate a quantizer on base (vec_id, embedding).

    calibration: "per_dim", or "flat_chunk", which takes consecutive n elements of the flat data for a dimension.
    """
    n, metric = known(name), metric.upper()
    V.metric(metric)
    if n == "SQ1" and metric == "L2":
        raise ValueError("SQ1 serves the metric IP only")
    first = base.select(F.size("embedding").alias("d")).first()
    q = Quantizer(n, metric, first["d"] if first else 0)
    if n == "SQ8U" and metric == "IP":
        sizes = elements(base, q.dim).select(F.abs("x").alias("x"))
        q.dif = trimmed(sizes, "x", 1)[1]
    elif n in GLOBAL:
        part, count = _prefix(base, q.dim, GLOBAL[n][2])
        q.lo, hi = trimmed(part, "x", trim_rank(count, GLOBAL[n][1]))
        q.dif = hi - q.lo
    elif n in PER_DIM:
        rows = base.count()
        limits = per_dim_limits(base, trim_rank(rows, PER_DIM[n][1]), q.dim, rows if calibration == "flat_chunk" else 0)
        q.los, q.difs = [limits[k][0] for k in sorted(limits)], [limits[k][1] - limits[k][0] for k in sorted(limits)]
    elif n == "PQ8":
        if codebook is None:
            from .kmeans import pq_codebook

            codebook = pq_codebook(base, q.dim)
        q.codebook = codebook
    return q


def per_dim_limits(base: DataFrame, top: int, dim: int = 0, chunk: int = 0) -> dict[int, tuple[float, float]]:
    """pos -> the top-th smallest and largest element of each dimension, or of each ``chunk`` elements of the flat data."""
    e = elements(base, dim)
    if chunk:  # positions in the flat data, in the order of vec_id, which is dense from 0
        e = e.select(F.floor((F.col("vec_id") * dim + F.col("pos")) / chunk).cast("int").alias("pos"), "x")
    return trimmed_by(e.select("pos", "x"), top)
