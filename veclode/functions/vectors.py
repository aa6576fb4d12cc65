"""Column expressions on vectors: distances, normalisation, reduced-precision grids, bit packing.

Arithmetic is in double. Distances are smaller-is-better: squared L2, negated dot product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def sound(v: Column, width: int) -> Column:
    """v as doubles, or an error if it is null, of another length than width or has an element that isn't a finite number."""
    x = doubles(v)
    good = v.isNotNull() & (F.size(v) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    said = F.concat(F.lit(f"a vector is not {width} finite numbers: "), F.coalesce(v.cast("string").substr(1, 100), F.lit("null")))
    return F.when(F.coalesce(good, F.lit(False)), x).otherwise(F.raise_error(said).cast("array<double>"))


def matrix(column, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows; an error says how many are null, of another length than width or have
    an element that isn't a finite number."""
    x = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if not x.null_count and len(flat) == len(x) * width and (not len(x) or (np.diff(x.offsets.to_numpy()) == width).all()) and np.isfinite(flat.sum()):
        return flat.reshape(-1, width)
    rows = [v.as_py() for v in x]
    bad = sum(v is None or len(v) != width or not all(e is not None and np.isfinite(e) for e in v) for v in rows)
    if bad:
        raise ValueError(f"{bad} of {len(rows)} vectors are not {width} finite numbers")
    return np.array(rows, np.float64).reshape(-1, width)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def ip(a: Column, b: Column) -> Column:
    """Negated dot product."""
    return -F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


METRICS = {"L2": l2, "IP": ip}


def metric(name: str):
    """The distance of a metric; an unknown name is an error."""
    try:
        return METRICS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}") from None


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _to_bits(x: Column, bits: int) -> Column:
    """x rounded to ``bits`` significant bits: the sum with a large multiple of x pushes the lower bits out."""
    c = x * F.lit(float(2 ** (53 - bits) + 1))
    return c - (c - x)


def fp16(x: Column) -> Column:
    """Half precision: 11 significant bits, multiples of 2**-24 below 2**-14."""
    return F.when(F.abs(x) < 2.0**-14, F.rint(x * 2.0**24) / 2.0**24).otherwise(_to_bits(x, 11))


def bf16(x: Column) -> Column:
    """8 significant bits."""
    return _to_bits(x, 8)


def e5m2(x: Column) -> Column:
    """Half precision cut (not rounded) to its upper byte: 3 significant bits."""
    h = fp16(x)
    t = F.abs(h)
    e = F.floor(F.log2(t))
    p = F.pow(F.lit(2.0), e)
    e = F.greatest(e + F.when(t >= p * 2, 1).when(t < p, -1).otherwise(0), F.lit(-14))
    step = F.pow(F.lit(2.0), e - 2)
    return F.when(t == 0, F.lit(0.0)).otherwise(F.signum(h) * F.floor(t / step) * step)


def packed(codes: Column, bits: int) -> Column:
    """Codes of 1, 2, 4 or 6 bits as bytes (0 to 255), the first code in the lowest bits; a last byte is filled with 0."""
    unit, per = (3, 4) if bits == 6 else (1, 8 // bits)
    n = F.ceil(F.size(codes) / per).cast("int")

    def group(g: Column) -> Column:
        ks = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.coalesce(F.get(codes, g * per + k), F.lit(0)).cast("long") * F.pow(F.lit(2.0), k * bits).cast("long"))
        whole = F.aggregate(ks, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.transform(F.sequence(F.lit(0), F.lit(unit - 1)), lambda b: F.floor(whole / F.pow(F.lit(256.0), b)).cast("long") % 256)

    return F.when(F.size(codes) > 0, F.transform(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), group)), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def unpacked(data: Column, bits: int, dim: int) -> Column:
    """The inverse of :func:`packed`."""
    unit, per = (3, 4) if bits == 6 else (1, 8 // bits)

    def code(i: Column) -> Column:
        g = F.floor(i / per).cast("int")
        whole = F.aggregate(F.sequence(F.lit(0), F.lit(unit - 1)), F.lit(0).cast("long"), lambda s, b: s + F.get(data, g * unit + b).cast("long") * F.pow(F.lit(256.0), b).cast("long"))
        return (F.floor(whole / F.pow(F.lit(2.0), (i % per) * bits)).cast("long") % (2**bits)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), code)
