"""Exact order statistics without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that may be sorted in one piece.
SORTED = 1_000_000


def kth_smallest(df: DataFrame, col: str, k: int) -> float:
    """The k-th smallest (from 1) value of a column.

    An interval around the value is narrowed by approximate percentiles and exact counts until what lies in it is
    small enough to sort; every step is one aggregation.
    """
    x = F.col(col)
    lo, hi, below, n = None, None, 0, df.select(col).count()
    if not 1 <= k <= n:
        raise ValueError(f"rank {k} of {n} values")
    while n > SORTED:
        part = df if lo is None else df.where((x >= lo) & (x <= hi))
        p = (k - below) / n
        a, b = part.agg(F.percentile_approx(x, [max(0.0, p - 0.002), min(1.0, p + 0.002)], 10000)).first()[0]
        less, upto = part.agg(F.sum((x < a).cast("long")), F.sum((x <= b).cast("long"))).first()
        if not less < k - below <= upto:  # the percentiles missed: the interval stays, and is wide enough to be split by them
            a, b = (a, hi if hi is not None else part.agg(F.max(x)).first()[0]) if k - below > upto else ((lo if lo is not None else part.agg(F.min(x)).first()[0]), b)
            less, upto = part.agg(F.sum((x < a).cast("long")), F.sum((x <= b).cast("long"))).first()
        if a == b:
            return a
        if upto - less == n:
            break
        below, n, lo, hi = below + less, upto - less, a, b
    part = df if lo is None else df.where((x >= lo) & (x <= hi))
    return part.select(col).orderBy(x).limit(k - below).agg(F.max(x)).first()[0]


def trimmed(df: DataFrame, col: str, top: int) -> tuple[float, float]:
    """The top-th smallest and the top-th largest value."""
    neg = df.select((-F.col(col)).alias(col))
    return kth_smallest(df, col, top), -kth_smallest(neg, col, top)


#: Bins that an interval is cut into a round.
BINS = 256


def trimmed_by(df: DataFrame, top: int) -> dict[int, tuple[float, float]]:
    """For each pos of df (pos, x) the top-th smallest and the top-th largest x (the last one there is, if fewer).

    Every round counts the values of each pos in bins of the interval that holds the wanted rank and goes on in one bin,
    between the least and the largest value found there; a pos is done when these are equal. A round is one aggregation to
    at most 2 * BINS rows a pos, whatever the rows are, and no value is sorted.
    """
    spark = df.sparkSession
    done: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}
    for r in df.groupBy("pos").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        for end, k in ((0, min(top, r["n"])), (1, max(r["n"] - top + 1, 1))):
            if k in (1, r["n"]):
                done[r["pos"], end] = r["a"] if k == 1 else r["b"]
            else:
                open_[r["pos"], end] = r["a"], r["b"], k
    positions = {p for p, _ in (*open_, *done)}
    while open_:
        done |= {key: a for key, (a, b, _) in open_.items() if a == b}
        open_ = {key: x for key, x in open_.items() if key not in done}
        if not open_:
            break
        asks = spark.createDataFrame([(p, e, a, b) for (p, e), (a, b, _) in open_.items()], "pos int, end int, a double, b double")  # two rows a pos at most
        x = df.join(F.broadcast(asks), "pos").where("x >= a and x <= b")
        x = x.withColumn("bin", F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * BINS), F.lit(BINS - 1)).cast("int"))
        found: dict[tuple[int, int], list] = {}
        for r in x.groupBy("pos", "end", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("pos", "end", "bin").collect():
            found.setdefault((r["pos"], r["end"]), []).append(r)
        for key, bins in found.items():
            k = open_[key][2]
            for r in bins:
                if k <= r["n"]:
                    open_[key] = r["lo"], r["hi"], k
                    if k == 1 or k == r["n"]:  # an end of the bin
                        done[key] = r["lo"] if k == 1 else r["hi"]
                    break
                k -= r["n"]
        open_ = {key: x for key, x in open_.items() if key not in done}
    return {p: (done[p, 0], done[p, 1]) for p in positions}
