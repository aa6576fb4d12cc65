"""Benchmark decontamination by spaced seeds.

A mask such as 11101011 names a window of words by the words under its ones and ignores those under its zeros, so a
substituted word there changes nothing. Seeds of all masks at all places of the benchmark are joined with those of the
texts by hash; a filter (bits of three hashes of every benchmark seed, about 48 bits a seed up to a fixed ceiling) lets only
likely places of the texts into that join. Items with the same words are one item until the end, so what is joined grows
with distinct items; a hit of a seed that several places of an item share counts once a diagonal. Around a hit the text and the item are laid over each other on the hit's diagonal, and the text
is contaminated if in some window of 16 words (all of a shorter item) at least 80 % are equal at their places.
A seed of more than 16 places of the benchmark, as a common phrase is, never meets the texts pair by pair: its places and
its hits, each with the words that a window around it can reach, are dealt to blocks, and a task compares a block of places
with a block of hits. Words are compared in lower case (A-Z) without ASCII punctuation, by 64-bit names.

Cases: null or blank texts and items have no words and match nothing; texts of any length are read whole, windows that
tie for the best count alike; items of up to
11 words have masks of their own, of up to 4 words the whole item; repeated items and rows count each; further columns are ignored;
an empty table of texts gives no rows, an empty benchmark no contaminated ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M1, M2, M3, keyed, mix, signed, small_batches, spans_of, table, texts, written
from .fingerprints import word_names

#: Masks for items of 12 words and more, and for shorter items by their number of words. However the words that the
#: rule lets differ lie in a window, one of its masks fits beside them; a test enumerates all cases.
MASKS = ("11101011", "110100111", "1100101011", "10110010011", "111000111")
SHORT = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"),
    7: ("11111", "111011", "110111"), 8: ("11111", "111011"), 9: ("111011",), 10: ("11111", "111011", "11010011"),
    11: ("1101011", "1110011"),
}
ALL = (*MASKS, *sorted({m for x in SHORT.values() for m in x}))
SPAN = max(map(len, ALL))
WINDOW, PERCENT = 16, 80
#: Bits of the filter at least and at most (64 MB), bits of a part of it that one group builds, and words kept on either side of
#: a hit.
LEAST, MOST, PART, AROUND = 1 << 24, 1 << 29, 1 << 19, 32
#: Places of the benchmark up to which a seed's hits are laid over each of them, rows of a block beyond that, and words of a
#: window before or after a hit.
FEW, BLOCK, REACH = 16, 1024, WINDOW - 1
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def masks_of(n: int) -> tuple[str, ...]:
    """The masks whose seeds an item of n words has."""
    return SHORT.get(n, MASKS) if n else ()


def seeds(name: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Names of all places by the words under the mask."""
    n = max(len(name) - len(mask) + 1, 0)
    out = np.full(n, salt, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ (out >> np.uint64(31))) * M1 + name[i : i + n] * M2
    return mix(out)


def filter_bits(n: int) -> int:
    """Size of the filter for n seeds, a power of two."""
    return min(MOST, max(LEAST, 1 << (48 * n - 1).bit_length() if n else LEAST))


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    m = np.uint64(size - 1)
    return [h & m, (h >> np.uint64(32)) & m, mix(h + M3) & m]


def _part(key, table):
    """A part of the filter as bytes, from the places of its bits."""
    import pyarrow as pa

    on = np.zeros(PART, np.uint8)
    on[table.column("b").to_numpy() % PART] = 1
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])


def _items(batches):
    """item_id, its place of a seed, the seed's mask and name."""
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(b.column("text"))
        ids = b.column("iid").to_numpy(zero_copy_only=False)
        name, _, _, at = word_names(PLAIN[raw], ends)
        rows: list[list] = [[], [], [], []]
        for i in range(len(ends) - 1):
            own = name[at[i] : at[i + 1]]
            k = [ALL.index(m) for m in masks_of(len(own))]
            h = [seeds(own, ALL[x], x) for x in k]
            rows[0].append(np.repeat(ids[i], sum(map(len, h))))
            rows[1] += [np.arange(len(x)) for x in h]
            rows[2] += h
            rows[3] += [np.repeat(x, len(y)) for x, y in zip(k, h, strict=True)]
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h = cat(rows[2], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(cat(rows[0], np.int64)), pa.array(cat(rows[1], np.int32)), pa.array(cat(rows[3], np.int32)), pa.array(signed(h))], names=["iid", "q", "k", "h"])


def _places(size: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(_bits(h, size))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PART), pa.array(at)], names=["part", "b"])

    return run


def _words(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(b.column("text"))
        name, _, _, at = word_names(PLAIN[raw], ends)
        yield pa.RecordBatch.from_arrays([b.column("iid"), pa.array([name[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["iid", "item"])


def _regions(bits, size: int, used: list[int]):
    """Regions of the texts around places that pass the filter with a mask in use: rid, first word, word names, hits (seed name, place)."""

    def run(batches):
        import pyarrow as pa

        table = np.frombuffer(bits.value, np.uint8)
        passes = lambda x: (table[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0
        kind = pa.struct([("h", pa.int64()), ("p", pa.int32())])
        for b in batches:
            raw, ends = texts(b.column("text"))
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            rows: list[list] = [[], [], [], []]
            for i, j in spans_of(ends):
                name, _, _, at = word_names(PLAIN[raw[ends[i] : ends[j]]], ends[i : j + 1] - ends[i])
                found_p, found_h = [], []
                for k in used:
                    m = ALL[k]
                    h = seeds(name, m, k)
                    p = np.arange(len(h))
                    for n in range(3):
                        ok = passes(_bits(h, size)[n])
                        h, p = h[ok], p[ok]
                    ok = p + len(m) <= at[np.searchsorted(at, p, "right")] if len(p) else np.zeros(0, bool)
                    found_p.append(p[ok])
                    found_h.append(h[ok])
                if not any(map(len, found_p)):
                    continue
                p, h = np.concatenate(found_p), np.concatenate(found_h)
                order = np.argsort(p, kind="stable")
                p, h = p[order], h[order]
                doc = np.searchsorted(at, p, "right") - 1
                new = np.ones(len(p), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (np.diff(p) > 2 * AROUND)
                cut = np.append(np.flatnonzero(new), len(p))
                for s, e in zip(cut[:-1], cut[1:], strict=True):
                    d = doc[s]
                    lo, hi = max(at[d], p[s] - AROUND), min(at[d + 1], p[e - 1] + SPAN + AROUND)
                    rows[0].append(rid[i + d])
                    rows[1].append(lo - at[d])
                    rows[2].append(name[lo:hi].tobytes())
                    rows[3].append([{"h": int(x), "p": int(y)} for x, y in zip(signed(h[s:e]), p[s:e] - lo, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.list_(kind))], names=["rid", "start", "region", "hits"])

    return run


def _overlap(batches):
    """Judge each diagonal: rid, item, the best window's equal words and size."""
    import pyarrow as pa

    for b in batches:
        best, size = [], []
        for r, t, d in zip(b.column("region").to_pylist(), b.column("item").to_pylist(), b.column("diagonal").to_pylist(), strict=True):
            r, t = np.frombuffer(r, np.uint64), np.frombuffer(t, np.uint64)
            lo, hi = max(0, -d), min(len(t), len(r) - d)  # places of the item that lie over the region
            w = min(WINDOW, len(t))
            same = np.concatenate(([0], np.cumsum(t[lo:hi] == r[lo + d : hi + d])))
            best.append(int((same[w:] - same[:-w]).max()) if len(same) > w else 0)
            size.append(w)
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("iid"), pa.array(best, pa.int64()), pa.array(size, pa.int64())], names=["rid", "iid", "equal", "size"])


def _around(words: str, place: str) -> list[Column]:
    """The words that a window around a place can reach, and how many the text lacks before them."""
    at, low = F.col(place), F.greatest(F.col(place) - REACH, F.lit(0))
    return [F.greatest(REACH - at, F.lit(0)).alias("lead"), F.substring(words, low * 8 + 1, (at + REACH + 1 - low) * 8).alias("near")]


def _near(table) -> tuple[np.ndarray, np.ndarray]:
    """A row of 2 * REACH + 1 words around each place, and which of them there are."""
    n = table.num_rows
    word, there = np.zeros((n, 2 * REACH + 1), np.uint64), np.zeros((n, 2 * REACH + 1), bool)
    for i, (x, lead) in enumerate(zip(table.column("near").to_pylist(), table.column("lead").to_pylist(), strict=True)):
        x = np.frombuffer(x, np.uint64)
        word[i, lead : lead + len(x)], there[i, lead : lead + len(x)] = x, True
    return word, there


def _compared(key, hits, places):
    """Judge a block of a seed's hits against a block of its places, by the windows around the seed."""
    import pyarrow as pa

    rid = hits.column("rid").to_numpy()
    (text, in_text), (item, in_item) = _near(hits), _near(places)
    out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for i, (iid, k, w) in enumerate(zip(*(places.column(c).to_pylist() for c in ("iid", "k", "size")), strict=True)):
        both = in_text & in_item[i]
        sums = np.zeros((2, len(rid), 2 * REACH + 2), np.int16)
        np.cumsum(both, axis=1, out=sums[0, :, 1:])
        np.cumsum(both & (text == item[i]), axis=1, out=sums[1, :, 1:])
        first = np.arange(REACH + len(ALL[k]) - w, REACH + 1)  # windows that hold the seed
        whole, equal = sums[:, :, first + w] - sums[:, :, first]
        best = np.where(whole == w, equal, 0).max(axis=1).astype(np.int64)
        ok = best * 100 >= w * PERCENT
        for x, y in zip(out, (rid[ok], np.full(ok.sum(), iid), best[ok], np.full(ok.sum(), w)), strict=True):
            x.append(y)
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["rid", "iid", "equal", "size"])


def in_blocks(hits: DataFrame, places: DataFrame) -> DataFrame:
    """(rid, iid, equal, size) of hits (h, rid, lead, near) and places of items (h, iid, k, size, lead, near) that share a
    passage. A side's rows are repeated for each block of the other, so rows are 2 / BLOCK of all pairs at most."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    both = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(places.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h")
    both = written(both.select("h", blocks("n").alias("n"), blocks("m").alias("m")), "blocks")
    own = lambda *c: F.xxhash64(*c)
    a = hits.join(both, "h").withColumn("x", F.pmod(own("rid", "near", "lead"), F.col("n")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    b = places.join(both, "h").withColumn("y", F.pmod(own("iid", "near", "lead"), F.col("m")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return a.drop("n", "m").groupBy("h", "x", "y").cogroup(b.drop("n", "m").groupBy("h", "x", "y")).applyInArrow(_compared, "rid long, iid long, equal long, size long")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(rid, item_id, percent) of texts (rid unique, text) that share a passage with a benchmark item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    named = benchmark.select(F.monotonically_increasing_id().alias("nr"), "item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = written(named.withColumn("same", F.unhex(F.sha2("text", 256))), "named")
    items = written(named.groupBy("same").agg(F.min("nr").alias("iid"), F.first("text").alias("text")), "items")
    seed = written(items.select("iid", "text").mapInArrow(_items, "iid long, q int, k int, h long"), "seeds")
    size = filter_bits(seed.count())
    parts = seed.select("h").mapInArrow(_places(size), "part long, b long").groupBy("part").applyInArrow(_part, "part long, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most MOST bits in all
        bits[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits.tobytes())
    used = sorted(r["k"] for r in seed.select("k").distinct().collect())  # a mask without seeds hits nothing
    regions = written(docs.select("rid", "text").mapInArrow(_regions(sent, size, used), "rid long, start long, region binary, hits array<struct<h:long,p:int>>"), "regions")
    names = written(items.select("iid", "text").mapInArrow(_words, "iid long, item binary"), "names")
    hits = regions.select("rid", "start", F.inline("hits"))
    common = written(seed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("h"), "common")
    lines = hits.join(seed.select("h", "iid", "q").join(common, "h", "left_anti"), "h")
    lines = lines.select("rid", "start", "iid", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    lines = lines.join(regions.select("rid", "start", "region"), ["rid", "start"]).join(names, "iid")
    judged = lines.select("rid", "iid", "region", "item", "diagonal").mapInArrow(_overlap, "rid long, iid long, equal long, size long")
    if not common.isEmpty():
        near = regions.select("rid", "region", F.inline("hits")).join(common, "h").select("h", "rid", *_around("region", "p")).distinct()
        places = seed.join(common, "h").join(names, "iid")
        places = places.select("h", "iid", "k", F.least(F.lit(WINDOW), F.length("item") / 8).cast("long").alias("size"), *_around("item", "q")).distinct()
        judged = judged.unionByName(in_blocks(written(near, "near"), written(places, "places")))
    judged = judged.where(F.col("equal") * 100 >= F.col("size") * PERCENT).groupBy("rid", "iid").agg(F.max(F.col("equal") * 100 / F.col("size")).alias("percent"))
    ids = items.select("iid", "same").join(named.select("same", "item_id"), "same").select("iid", "item_id")
    return judged.join(ids, "iid").select("rid", "item_id", "percent")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents share a passage with the benchmark, with how many items, and the best share of equal words.

    Cases: null and blank texts and items match nothing; texts of any length are read whole; repeated items count each, of
    several the first by item_id is named; repeated rows and ties get their own row each; further columns, of the
    benchmark too, are ignored; an empty table gives no rows, an empty benchmark no contaminated ones.
    """
    docs, _ = keyed(table(spark, sf_dir, "documents"), "op4")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    found = found.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.max("percent").alias("percent"))
    out = docs.select("rid", "doc_id").join(found, "rid", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), "first_item", "percent", F.col("n").isNotNull().alias("contaminated"), F.col("n").isNull().alias("kept"))
