"""Mixing sources to target weights by Sainte-Lague apportionment.

The words to be taken are cut into equal blocks (seats). A source with target ``v`` bids ``v / (2 s + 1)`` for its
seat number ``s``; the highest bids win, which gives each source an integer quota, and as seats go to shards in turn,
each (source, shard) a quota too. Documents of a source are laid end to end in the order of a seeded hash; laid out
again and again they are a tape, of which each shard takes the blocks of its quota, shard after shard. Only
built-in functions are used, and no group of documents is ordered whole: a source is split in ``RANGES`` parts by its hash,
and each part, where there are many documents, in intervals of the hash. The order doesn't depend on how many.

Cases: a null text has size 0 and is taken 0 times; a null source is a source, the last one; repeated rows count each
for itself (ties of the order are broken by size, which leaves equal rows interchangeable); texts of any length only count;
further columns are kept by :func:`mix`, ignored by the query; an empty table gives no rows; if no source has words,
targets and taken words are 0. The table of sources, a row each, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, table

#: Blocks that the mix is cut into, at least; and blocks of the smallest target, at least, down to blocks of one word.
SEATS, FINE = 65536, 64
SHARDS, SEED, RANGES, MOST = 16, "mix-1", 256, 3
#: Rows that a range of a source has at most, about, so that no task orders more.
RANGE_ROWS = 1 << 17


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight 1, 2, 3, repeating by code point with null last, and the capped target.

    The fixed point of "share by weight, stop at MOST times the size, share the excess again" is
    ``min(MOST * size, lam * weight)``; with sources in the order of MOST * size / weight, lam comes from running
    sums. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    t = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    t = t.withColumn("_cap", F.col("source_size").cast("double") * MOST).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    all_, upto = Window.partitionBy(F.lit(1)), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "_total": F.sum(F.col("source_size").cast("double")).over(all_),
        "_left": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "_full": F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)),
    })
    # If all sources before this one are full, the rest shares what is left; the first that stays below its cap sets lam.
    t = t.withColumn("_lam", (F.col("_total") - F.col("_full")) / F.col("_left"))
    t = t.withColumn("_first", F.min(F.when(F.col("_lam") <= F.col("_ratio"), F.struct("_ratio", "_lam"))).over(all_)["_lam"])
    return t.select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_first"), F.lit(0.0)) * F.col("weight")).alias("target"))


def quotas(goals: DataFrame, seats: int = SEATS, shards: int = SHARDS) -> DataFrame:
    """(source, ...) -> with ``block`` (words) and ``quota`` (blocks won), and ``by_shard``: the quota of each shard.

    A block is a ``seats``-th of the mix, or a ``FINE``-th of the smallest target where that is less. Seats that are
    certain are counted, not ranked: at the divisor ``V / (seats - sources / 2)`` quotas rounded to the nearest can't
    exceed the seats. Of the others those up to a divisor at which they can't fall short are ranked, which are a few
    a source, whatever the corpus holds.
    """
    all_ = Window.partitionBy(F.lit(1))
    g = goals.withColumn("block", F.greatest(F.lit(1.0), F.least(F.round(F.sum("target").over(all_) / seats), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_) / FINE).cast("double"))))
    g = g.withColumn("_total", F.sum("target").over(all_)).withColumn("_seats", F.round(F.col("_total") / F.col("block")).cast("long"))
    g = g.withColumn("_most", F.when(F.col("target") > 0, F.floor(F.col("source_size") * MOST / F.col("block"))).otherwise(0).cast("long"))
    b = g.where("_most > 0").withColumn("_n", F.count(F.lit(1)).over(all_))
    near = lambda d: F.floor(F.col("target") / d + 0.5).cast("long")
    b = b.withColumn("_sure", F.when(F.col("_seats") * 2 > F.col("_n"), F.least("_most", F.greatest(F.lit(0).cast("long"), near(F.col("_total") / (F.col("_seats") - F.col("_n") / 2)) - 1))).otherwise(0).cast("long"))
    # At divisor d a source wins min(_most, target / d - 1/2) seats at least; the largest d at which these make all seats
    # comes from running sums over the sources in the order in which they reach _most, as in targets().
    b = b.withColumn("_full_at", F.col("target") / (F.col("_most") + 0.5))
    by_full = Window.orderBy(F.col("_full_at").desc(), F.col("source").isNull(), F.col("source").cast("binary"))
    rest = by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    b = b.withColumns({
        "_before": F.coalesce(F.sum("_most").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum("target").over(rest), "_left": F.count(F.lit(1)).over(rest),
        "_off": F.coalesce(F.sum("_sure").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_given": F.sum("_sure").over(all_),
    })
    need = F.col("_seats") - F.col("_before") + F.col("_left") / 2
    b = b.withColumn("_d", F.when(need > 0, F.col("_open") / need))
    b = b.withColumn("_d", F.max(F.when(F.col("_d") >= F.col("_full_at"), F.struct("_full_at", "_d"))).over(all_)["_d"])
    b = b.withColumn("_upto", F.least("_most", F.coalesce(near(F.col("_d")) + 1, F.col("_most"))))
    bids = b.where("_upto > _sure").select("source", "target", "block", "_total", "_seats", "_given", F.explode(F.sequence(F.col("_sure"), F.col("_upto") - 1)).alias("_s"))
    # Blocks of a seats-th are ranked as in the SQL, by quotients as floats. In finer ones quotients that are equal but for
    # rounding go to the smaller target first.
    bid, fine = F.col("target") / (2 * F.col("_s") + 1), F.col("block") < F.round(F.col("_total") / seats)
    order = Window.orderBy(F.when(fine, F.round(bid / F.col("block"), 9)).otherwise(bid).desc(), F.when(fine, F.round("target", 6)), F.col("source").isNull(), F.col("source").cast("binary"), "_s")
    won = bids.withColumn("_rank", F.row_number().over(order) + F.col("_given")).where(F.col("_rank") <= F.col("_seats"))
    ranked = won.select("source", ((F.col("_rank") - 1) % shards).cast("int").alias("shard"), F.lit(1).cast("long").alias("n"))
    # Certain seats go to shards in turn as well, source after source, before the ranked ones.
    upto = lambda x: F.floor((x - F.col("shard") - 1) / shards)
    sure = b.where("_sure > 0").select("source", "_off", "_sure", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sure = sure.select("source", "shard", (upto(F.col("_off") + F.col("_sure")) - upto(F.col("_off"))).cast("long").alias("n")).where("n > 0")
    per = ranked.unionByName(sure).groupBy("source", "shard").agg(F.sum("n").alias("n"))
    per = per.groupBy("source").agg(F.sum("n").alias("quota"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("shard", "n")))).alias("by_shard"))
    return g.alias("g").join(per.alias("p"), F.col("g.source").eqNullSafe(F.col("p.source")), "left").select("g.source", "source_size", "weight", "target", "block", F.coalesce("quota", F.lit(0)).alias("quota"), "by_shard")


def mix(docs: DataFrame, size: str = "size", source: str = "source", seed: str = SEED, seats: int = SEATS, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (with doc_id, ``size`` and ``source``) with source_size, target, quota, block, ``words`` (array: how many of the
    document's words each shard of the mix takes, repeats counted) and taken, their sum."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    cuts = docs.count() // (RANGES * range_rows) + 1
    first = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    d = docs.withColumn("_h", key).withColumn("_range", F.pmod(first, F.lit(RANGES)) * cuts + F.shiftright(first * cuts, 32))
    parts = d.groupBy(F.col(source).alias("source"), "_range").agg(F.sum(size).alias("_n"))
    q = quotas(targets(parts.groupBy("source").agg(F.sum("_n").alias("source_size"))), seats, shards)
    # Where each shard's part of the source's tape ends, from the quotas by shard.
    most = F.col("source_size") * MOST
    ends = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda h: F.aggregate(F.sequence(F.lit(0), h), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.element_at("by_shard", x), F.lit(0))))
    q = q.withColumn("_ends", F.transform(ends, lambda n: F.least((n * F.col("block")).cast("long"), most)))
    base = parts.withColumn("_base", F.sum("_n").over(Window.partitionBy("source").orderBy("_range")) - F.col("_n")).alias("b")
    base = base.join(q.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source"))).select(
        F.col("b.source").alias("_source"), F.col("_range").alias("_r"), "_base", "source_size", "target", "block", "quota", "_ends")
    run = Window.partitionBy(source, "_range").orderBy("_h", size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_end", F.sum(size).over(run))
    d = d.join(base, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    d = d.withColumn("_start", F.col("_base") + F.col("_end") - F.col(size))

    def upto(x):  # the document's words on the tape's first x words
        n = F.floor(x / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
        return n * F.col(size) + F.greatest(F.lit(0).cast("long"), F.least(F.col(size), x - n * F.col("source_size") - F.col("_start")))

    d = d.withColumn("_upto", F.transform("_ends", upto))
    d = d.withColumn("words", F.transform("_upto", lambda x, h: x - F.when(h > 0, F.get("_upto", h - 1)).otherwise(0)))
    d = d.withColumn("taken", F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x))
    return d.drop("_h", "_range", "_end", "_start", "_upto", "_ends", "_source", "_r", "_base")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, from its source's quotas of all shards.

    Cases: null and blank texts have size 0 and are taken 0 times; a null source is the last source; ties of the seeded
    order go by size; repeated rows count each; texts of any length count whole; further columns are ignored; an empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")
