"""Repeated substrings by bucket-pointer refinement of a sampled suffix array.

A substring is repeated if it starts at two places. The places that are sorted are a sample of all suffixes, the anchors:
of the 369 32-grams in each 400-byte window the least one (leftmost on ties), which equal windows choose alike.

* Initial buckets are an anchor's 32-gram. An anchor alone in its bucket leaves with all its windows.
* The next buckets are phrases, from an anchor to the end of the next one's gram. A bucket's identifier is a pointer, the
  least number of its places. Then buckets are refined round by round: the bucket of 4k phrases is that of the identifiers
  of k phrases at a place and k, 2k and 3k phrases later, found by the round before; places alone in a bucket leave, and
  the new pointers are what the next round sorts on.
* The windows between two anchors lie in a chain of phrases. Where a chain is in a bucket with others, which the
  identifiers of its first, second, third and last 4^r phrases tell, all these windows are repeated. Of each such bucket
  one place goes on to stand for all.
* What is left, windows at the ends of matches mostly, is refined by bytes, 32 windows of an anchor at a time: the 369
  bytes that all of them share must be repeated, else none is; if the 431 bytes that they cover together are, all are;
  else the 32 windows are named one by one. Names of these lengths are again pairs of two identifiers, of 256 bytes at two
  offsets, which a task doubles up on its own text.

Phrases have names of 128 bits, byte strings of 96; pointers taken together are exact. Texts are shuffled once, compressed, to a
table bucketed by document of those that hold a repeated anchor; a group of places never meets in one task, as only counts
are aggregated.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BYTES, M1, M2, M3, bucketed, keyed, mix, signed, small_batches, spans_of, table, texts, unzipped, written, zipped
from .fingerprints import BASE, INVERSE, _power

LENGTH, GRAM, BLOCK = 400, 32, 32
#: Bytes of texts that are named at once: what fits a core's cache.
NAMED = 1 << 16
#: How many pointers a round of refinement takes together.
WAYS = 4
CORE, HULL = LENGTH - BLOCK + 1, LENGTH + BLOCK - 1
LOW = np.uint64(0xFFFFFFFF)
#: A second set of numbers for byte values and a second base, independent of the first.
BYTES2 = mix(BYTES ^ M3)
BASE2 = 0xC2B2AE3D27D4EB4F
INVERSE2 = pow(BASE2, -1, 2**64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * M1
    x += b
    x ^= x >> np.uint64(29)
    return x


def names(raw: np.ndarray, length: int, values: np.ndarray = BYTES) -> np.ndarray:
    """Bucket identifiers of all places by the ``length`` (a power of two) bytes from there."""
    x, k = values[raw], 1
    while k < length:
        if len(x) <= k:
            return x[:0]
        x = _pair(x[:-k], x[k:])
        k *= 2
    return x


def _name(n256: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of ``length`` (257 to 512) bytes from two shorter identifiers, the second at a later offset."""
    return _pair(n256[at] * M2 + np.uint64(length), n256[at + (length - 256)])


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    k = 1
    n = len(v) - w + 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[:n], v[w - k : w - k + n])


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, step: int = 1 << 15):
    """(document, anchor, first, last + 1 window, gram name) for each run of windows with one anchor; places in raw."""
    w, at, name, lo, hi = length - GRAM + 1, [], [], [], []
    for c in range(0, len(raw) - length + 1, step):
        g = names(raw[c : c + step + length - 1], GRAM)
        v = (g & ~LOW) | np.arange(c, c + len(g), dtype=np.uint64)
        a = (_least(v, w) & LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(a)) + 1
        first = np.concatenate(([0], cut))
        at.append(a[first])
        name.append(g[a[first] - c])
        lo.append(first + c)
        hi.append(np.concatenate((cut, [len(a)])) + c)
    if not at:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at, name, lo, hi = map(np.concatenate, (at, name, lo, hi))
    same = np.concatenate(([False], (at[1:] == at[:-1]) & (lo[1:] == hi[:-1])))  # a run cut by a step
    first = np.flatnonzero(~same)
    at, name, lo, hi = at[first], name[first], lo[first], hi[np.concatenate((first[1:], [len(same)])) - 1]
    # Windows must lie in one document; between two documents' windows lie more than one run can span.
    long = np.flatnonzero(np.diff(ends) >= length)
    if not len(long):
        return at[:0], at[:0], at[:0], at[:0], name[:0]
    begin, end = ends[long], ends[long + 1] - length
    d = np.minimum(np.searchsorted(end, lo), len(long) - 1)
    lo, hi = np.maximum(lo, begin[d]), np.minimum(hi, end[d] + 1)
    ok = lo < hi
    return long[d[ok]], at[ok], lo[ok], hi[ok], name[ok]


def _anchors(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(b.column("text"))
        rid = b.column("rid").to_numpy(zero_copy_only=False)
        d, a, _, _, name = anchors(raw, ends)
        yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(rid[d]), pa.array((a - ends[d]).astype(np.int32))], names=["gram", "rid", "a"])


def _lists(col):
    """Flat columns of a list-of-structs column, and where each row's part begins and ends."""
    flat = col.flatten()
    n = np.diff(col.offsets.to_numpy())
    return [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields)], np.concatenate(([0], np.cumsum(n)))


def _left(b, raw: np.ndarray, ends: np.ndarray):
    """All runs of windows of a batch, and which of their anchors are left."""
    (spots,), at = _lists(b.column("spots"))
    d, a, lo, hi, _ = anchors(raw, ends)
    own = np.repeat(np.arange(len(ends) - 1), np.diff(at))
    return d, a, lo, hi, np.isin(a, spots + ends[own])


def _phrase_names(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    out = []
    for values, base, inverse in ((BYTES, BASE, INVERSE), (BYTES2, BASE2, INVERSE2)):
        h = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * _power(base, len(raw)), out=h[1:])
        out.append(mix((h[b] - h[a]) * _power(inverse, len(raw))[a] + (b - a).astype(np.uint64)))
    return out


def _chains(x: np.ndarray, size: int, gone: np.ndarray) -> list[np.ndarray]:
    """Of a text's anchors x: (s, e, lo, hi) for windows lo to hi - 1 that lie in the phrases from anchor s to e, all of which
    are left; gone: how many before each are not."""
    if len(x) < 2:
        return [x[:0]] * 4
    cut = np.unique(np.concatenate((x, x - (LENGTH - GRAM) + 1, [0, size - LENGTH + 1])))
    cut = cut[(cut >= 0) & (cut <= size - LENGTH + 1)]
    lo, hi = cut[:-1], cut[1:]
    s, e = np.searchsorted(x, lo, "right") - 1, np.searchsorted(x, lo + LENGTH - GRAM)
    ok = (s >= 0) & (e < len(x))
    ok[ok] = gone[e[ok] + 1] == gone[s[ok]]
    return [v[ok] for v in (s, e, lo, hi)]


def _phrases(batches):
    """Phrases (rid, i: number of the anchor in its text, names; k 0), and chains from anchor i to e that hold the windows lo
    to hi - 1 and whose anchors are all left; k: the round that settles them, the greatest power of WAYS up to e - i."""
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(unzipped(b))
        rid = b.column("rid").to_numpy(zero_copy_only=False)
        d, a, _, _, left = _left(b, raw, ends)
        first = np.searchsorted(d, np.arange(len(ends)))
        for i, j in spans_of(ends):
            r = np.arange(first[i], max(first[i], first[j] - 1))
            whole = r[(d[r + 1] == d[r]) & left[r + 1] & left[r]]
            names2 = _phrase_names(raw[ends[i] : ends[j]], a[whole] - ends[i], a[whole + 1] + GRAM - ends[i])
            chains = []
            for k in range(i, j):
                own = slice(first[k], first[k + 1])
                found = _chains(a[own] - ends[k], ends[k + 1] - ends[k], np.concatenate(([0], np.cumsum(~left[own]))))
                chains.append([np.full(len(found[0]), rid[k]), *found])
            c = [np.concatenate(x).astype(np.int64) for x in zip(*chains, strict=True)]
            n, m = len(whole), len(c[0])
            both = lambda x, y: pa.concat_arrays([pa.nulls(n, pa.int32()) if x is None else pa.array(x), y])  # noqa: B023, E731
            ints = lambda x: pa.array(x.astype(np.int32))
            k = WAYS ** np.searchsorted(WAYS ** np.arange(1, 16), c[2] - c[1], "right")
            yield pa.RecordBatch.from_arrays(
                [both(rid[d[whole]], pa.array(c[0])), both((whole - first[d[whole]]).astype(np.int32), ints(c[1])), *[both(None, ints(x)) for x in c[2:]], *[both(signed(h), pa.nulls(m, pa.int64())) for h in names2], both(np.zeros(n, np.int32), ints(k))],
                names=["rid", "i", "e", "lo", "hi", "h1", "h2", "k"])


def _second(x: np.ndarray):
    """The upper half of a second name."""
    import pyarrow as pa

    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _blocks(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(unzipped(b))
        rid = b.column("rid").to_numpy(zero_copy_only=False)
        d, a, lo, hi, left = _left(b, raw, ends)
        d, a, lo, hi = d[left], a[left], lo[left], hi[left]
        (x, y), at = _lists(b.column("settled"))
        first = np.searchsorted(d, np.arange(len(ends)))
        for i, j in spans_of(ends, NAMED):
            s = slice(first[i], first[j])
            if s.start == s.stop:
                continue
            part = raw[ends[i] : ends[j]]
            own = (ends[i:j] - ends[i])[np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))]
            m = np.zeros(len(part) + 1, np.int32)
            np.add.at(m, x[at[i] : at[j]] + own, 1)
            np.add.at(m, y[at[i] : at[j]] + own, -1)
            open_ = np.concatenate(([0], np.cumsum(np.cumsum(m)[: len(part)] == 0)))  # windows in question before each place
            n256 = [names(part, 256, values) for values in (BYTES, BYTES2)]
            k0, k1 = (a[s] - hi[s] + 1) // BLOCK, (a[s] - lo[s]) // BLOCK
            n = k1 - k0 + 1
            r = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + k0[r]
            ax, doc, p0 = a[s][r], d[s][r], a[s][r] - k * BLOCK - BLOCK + 1
            u, v = np.maximum(lo[s][r], p0), np.minimum(hi[s][r], p0 + BLOCK)
            ok = open_[v - ends[i]] > open_[u - ends[i]]
            k, ax, doc, p0, u, v = (c[ok] for c in (k, ax, doc, p0, u, v))
            core = [_pair(_name(c, ax - ends[i] - k * BLOCK, CORE), k.astype(np.uint64)) for c in n256]
            whole = (p0 >= ends[doc]) & (p0 + HULL <= ends[doc + 1])
            edge = mix(rid[doc].astype(np.uint64) * M1 + (p0 - ends[doc]).astype(np.uint64) * M2 + k.astype(np.uint64))  # at an edge of its text: like no other
            hull = [edge.copy(), edge.copy()]
            for c, names_ in zip(hull, n256, strict=True):
                c[whole] = _name(names_, (p0 - ends[i])[whole], HULL)
            ints = [pa.array((c - ends[doc]).astype(np.int32)) for c in (p0, u, v)]
            yield pa.RecordBatch.from_arrays([pa.array(rid[doc]), *ints, pa.array(signed(core[0])), _second(core[1]), pa.array(signed(hull[0])), _second(hull[1])], names=["rid", "p0", "lo", "hi", "core", "core2", "hull", "hull2"])


def _windows(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(unzipped(b))
        rid = b.column("rid").to_numpy(zero_copy_only=False)
        (lo, hi), at = _lists(b.column("ranges"))
        for i, j in spans_of(ends, NAMED):
            part = raw[ends[i] : ends[j]]
            n256 = [names(part, 256, values) for values in (BYTES, BYTES2)]
            s = slice(at[i], at[j])
            doc = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
            n = hi[s] - lo[s]
            x = np.repeat(np.arange(len(n)), n)
            p = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + lo[s][x]
            w = [_name(y, ends[doc[x]] - ends[i] + p, LENGTH) for y in n256]
            yield pa.RecordBatch.from_arrays([pa.array(rid[doc[x]]), pa.array(lo[s][x].astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(signed(w[0])), _second(w[1])], names=["rid", "lo", "p", "w", "w2"])


def _cut(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(unzipped(b))
        (lo, hi), at = _lists(b.column("covered"))
        gone, spans, sha = [], [], []
        for i in range(len(ends) - 1):
            t = raw[ends[i] : ends[i + 1]]
            m = np.zeros(len(t) + 2, np.int32)
            np.add.at(m, lo[at[i] : at[i + 1]] + 1, 1)
            np.add.at(m, hi[at[i] : at[i + 1]] + 1, -1)
            m = np.cumsum(m) > 0
            gone.append(int(m[1:-1].sum()))
            spans.append(int((m[1:] & ~m[:-1]).sum()))
            sha.append(hashlib.sha256(t[~m[1:-1]].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["rid", "n_removed", "n_spans", "kept"])


def _bucketed_places(places: DataFrame, key: list[str]) -> DataFrame:
    """places (n, rid, i, key) that are not alone in their bucket, as (n, rid, i, bucket): the pointer to its first place."""
    # What is joined to many rows of a hot key is written first: Spark splits a skewed join whose sides are both shuffled.
    often = written(places.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("n").alias("_pointer")).where("_n > 1").drop("_n"), "buckets")
    return written(places.join(often, key).select("n", "rid", "i", F.col("_pointer").alias("bucket")), "places")


def refined(phrases: DataFrame, chains: DataFrame):
    """Rounds of refinement over phrases (n, rid, i, h1, h2): yields k = 1, 4, 16 ... and (n, rid, i, b0 to b3) of all places
    whose k phrases are met again: b0 is their bucket, b1 to b3 are those of k phrases k, 2k and 3k later, null if they aren't
    met again. A text takes part as long as it has chains (rid, i, e) of 4k phrases or more; texts that have a chain in common
    have it both, so none loses its partner."""
    k, level, key = 1, _bucketed_places(phrases, ["h1", "h2"]), [f"b{j}" for j in range(WAYS)]
    long = written(chains.groupBy("rid").agg(F.max(F.col("e") - F.col("i")).alias("m")), "long")
    while level.limit(1).count():
        text = Window.partitionBy("rid").orderBy("i")
        level = written(level.select("n", "rid", "i", F.col("bucket").alias("b0"), *[F.max("bucket").over(text.rangeBetween(j * k, j * k)).alias(key[j]) for j in range(1, WAYS)]), "pointers")
        yield k, level
        k *= WAYS
        level = _bucketed_places(level.dropna(subset=key).join(long.where(F.col("m") >= k).select("rid"), "rid", "left_semi"), key)


def settled(rows: DataFrame) -> DataFrame:
    """(rid, lo, hi, lead): windows in chains of phrases that are met again; lead: the one of its bucket that stands for all.
    rows: (n, rid, i, e, lo, hi, h1, h2, k), phrases where k is 0, else chains."""
    chains, none = rows.where("k > 0").select("n", "rid", "i", "e", "lo", "hi", "k"), "rid long, lo int, hi int, lead boolean"
    # A window has at most LENGTH phrases: a handful of powers of four.
    powers = {r["k"] for r in chains.select("k").distinct().collect()}
    out = rows.sparkSession.createDataFrame([], none)
    for k, level in refined(rows.where("k = 0").select("n", "rid", "i", "h1", "h2"), chains):
        if k in powers:
            # The pointers of a chain: as many whole steps of k as it has, and the last k phrases.
            own = chains.where(F.col("k") == k).withColumn("m", F.col("e") - F.col("i"))
            steps = [f"b{j}" for j in range(WAYS - 1)]
            own = own.join(level.select("rid", "i", *steps), ["rid", "i"])
            own = own.select("n", "rid", "e", "lo", "hi", "m", *[F.when(F.col("m") >= (j + 1) * k, F.col(b)).otherwise(-1).alias(b) for j, b in enumerate(steps)]).dropna(subset=steps)
            own = own.join(level.select("rid", (F.col("i") + k).alias("e"), F.col("b0").alias("last")), ["rid", "e"])
            key = ["m", *steps, "last"]
            own = written(own.select("n", "rid", "lo", "hi", *key), "chains")
            often = written(own.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("n").alias("_first")).where("_n > 1").drop("_n"), "often")
            out = out.unionByName(own.join(often, key).select("rid", "lo", "hi", (F.col("n") == F.col("_first")).alias("lead")))
        if k >= max(powers, default=0):
            break
    return written(out, "settled")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (rid unique, text): the texts in which anything may repeat (rid, size, zipped, spots), as a bucketed table, and
    (rid, lo, hi): bytes covered by 400-byte strings that also start elsewhere."""
    spots = written(docs.select("rid", "text").mapInArrow(_anchors, "gram long, rid long, a int"), "anchors")
    often = written(spots.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
    left = spots.join(often, "gram", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("a")).alias("spots"))
    held = bucketed(zipped(docs.select("rid", "text")).join(left, "rid"), "rid", "texts")

    rows = held.mapInArrow(_phrases, "rid long, i int, e int, lo int, hi int, h1 long, h2 long, k int")
    known = settled(written(rows.select(F.monotonically_increasing_id().alias("n"), "*"), "phrases", ["k"]))
    skip = known.where("not lead").groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("settled"))
    asked = held.join(skip, "rid", "left").withColumn("settled", F.coalesce("settled", F.array().cast("array<struct<lo:int,hi:int>>")))
    blocks = asked.select("rid", "size", "zipped", "spots", "settled").mapInArrow(_blocks, "rid long, p0 int, lo int, hi int, core long, core2 int, hull long, hull2 int")
    blocks = written(blocks, "blocks")
    by_hull = blocks.groupBy("core", "core2", "hull", "hull2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "lo", "hi")).alias("one"))
    by_hull = written(by_hull, "hulls")
    hull = ["core", "core2", "hull", "hull2"]
    whole = blocks.join(by_hull.where("n > 1").select(*hull), hull, "left_semi").select("rid", F.col("p0").alias("lo"), (F.col("p0") + HULL).alias("hi"))
    # In question: hulls met once whose core is met again, and one of each repeated hull that such a core has.
    by_core = by_hull.groupBy("core", "core2").agg(F.count(F.lit(1)).alias("hulls"), F.max(F.col("n") == 1).alias("open")).where("hulls > 1 and open").select("core", "core2")
    ranges = by_hull.join(by_core, ["core", "core2"], "left_semi").select("one.*").groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    single = written(held.select("rid", "size", "zipped").join(ranges, "rid").select("rid", "size", "zipped", "ranges").mapInArrow(_windows, "rid long, lo int, p int, w long, w2 int"), "windows")
    twice = written(single.groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "w2"), "twice")
    part = single.join(twice, ["w", "w2"], "left_semi").groupBy("rid", "lo").agg(F.min("p").alias("a"), F.max("p").alias("b")).select("rid", F.col("a").alias("lo"), (F.col("b") + LENGTH).alias("hi"))
    inside = known.select("rid", "lo", (F.col("hi") + LENGTH - 1).alias("hi"))
    return held, whole.unionByName(part).unionByName(inside)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in 400-byte strings that also start anywhere else are removed.

    Cases: a null or empty text has no bytes; texts under 400 bytes lose nothing; a text of any length is read whole, one at a
    time where it is longer than a batch; strings are equal if names of 96 bits (chains: of 128) are; rows that repeat another row are
    documents of their own, so both lose what they share; further columns are ignored; an empty table gives no rows.
    """
    small_batches(spark)
    docs, _ = keyed(table(spark, sf_dir, "documents"), "op2")
    held, covered = repeated(docs)
    cut = held.select("rid", "size", "zipped").join(covered.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("covered")), "rid")
    cut = cut.select("rid", "size", "zipped", "covered").mapInArrow(_cut, "rid long, n_removed long, n_spans long, kept string")
    text = F.coalesce("text", F.lit(""))
    all_ = docs.select("rid", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    out = all_.join(cut, "rid", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
