"""Near duplicates: MinHash bands find pairs, odd sketches judge them, full shingle sets confirm them.

* Texts with the same words become one node, named by two 64-bit names of the whole sequence.
* Of 1024 MinHashes of a node's shingles 96 make 24 bands of 4 (a pair at 85 % shares none with probability
  2e-8, one at 80 % with 3e-6); all, folded into a bitmap of 4096 parities, are its odd sketch. The XOR of two sketches has few ones if the
  MinHashes agree: ``J = 1 + n / (4 k) * ln(1 - 2 ones / n)``. Pairs whose estimate lies more than five deviations
  below the threshold are let go, as are those whose sets differ too much in size.
* Rounds of stars: in every bucket that holds several components a hub, from another component than the last round's, is
  compared with the nodes of all others; confirmed links join components, as long as a round links one in ``PAYS`` of
  the nodes in such buckets. The number of rounds decides nothing but the work that is left to the next step.
* In buckets that still hold several components, nodes of different components are compared, block by block. A bucket of
  more than ``HOT`` nodes, as one very common passage makes it, is split by rare shingles first, which loses no link: of
  two sets of size n that meet the threshold t, in any order that all sets share, the first ``n - ceil(t n) + 1`` shingles
  of each have one in common. The order is by how often shingles occur in the hot buckets (counted in ``SLOTS`` slots), so a
  passage comes last, and texts that share nothing else don't meet.
  Pairs inside a component would change nothing, so no group of copies is expanded into all its pairs.
* A block whose sketches let more than ``MANY`` pairs a node pass, as texts just under the threshold do, states no pairs: it is
  compared once more with the full sets at hand, and states a link only where that joins components.
* A link counts if the full sets of 64-bit shingle names meet the threshold.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M1, M2, M3, bucketed, keyed, mix, signed, small_batches, spans_of, table, texts, written
from .fingerprints import INVERSE, _power, BASE, sequence_names, word_names

SHINGLE, PERCENT = 5, 85
HASHES, BANDED, ROWS, BITS = 1024, 96, 4, 4096
#: Deviations above the expected ones in the XOR of two sketches from which a pair is let go.
DEVIATIONS = 5.6
BLOCK, HOT, PAYS = 4096, 1024, 20
#: Slots in which shingles are counted to tell rare ones from common ones.
SLOTS = 1 << 16
#: Pairs a node from which a block is compared on full sets, and shingles of a block then.
MANY, SETS = 4, 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * M2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_R = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * M3) >> np.uint64(32)).astype(np.uint32)


def most_ones(percent: int) -> int:
    """Ones in the XOR of two sketches from which a pair is let go: 401 at 85 %, 497 at 80 %.

    A pair at the threshold has D ~ Binomial(HASHES, 1 - J) MinHashes that differ, which flip 2 D of the bits; the ones
    vary with D and, given D, with how often two flips meet.
    """
    miss = 1 - percent / 100
    flips = 2 * HASHES * miss / BITS
    mean = BITS / 2 * (1 - math.exp(-2 * flips))
    of_d = 4 * math.exp(-4 * flips) * HASHES * miss * (1 - miss)
    met = BITS / 4 * (1 - math.exp(-4 * flips)) - BITS * flips * math.exp(-4 * flips)
    return math.ceil(mean + DEVIATIONS * math.sqrt(of_d + met))


def _minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for c in range(0, len(x), 1024):
        out = np.minimum(out, ((x[None, c : c + 1024] ^ _R[:, None]) * _A[:, None]).min(axis=1))
    return out


def _sets(raw: np.ndarray, ends: np.ndarray):
    """For each text its sorted distinct shingle names; and the word names, and how many words come before each text."""
    name, _, _, at = word_names(_LOWER[raw], ends)
    s = sequence_names(name, SHINGLE, 8)
    sets = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        if j - i >= SHINGLE:
            sets.append(np.unique(s[i : j - SHINGLE + 1]))
        else:  # the whole sequence as one shingle; none has none
            sets.append(sequence_names(name[i:j], j - i, 100 + j - i)[:1] if j > i else s[:0])
    return sets, name, at


def _sign(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(b.column("text"))
        n, keys, bands, odds = [], [[], []], [np.zeros((0, BANDED // ROWS), np.uint64)], [np.zeros((0, BITS // 64), np.int64)]
        for i, j in spans_of(ends):
            sets, name, at = _sets(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            n += [len(s) for s in sets]
            for k, x in enumerate((name, mix(name ^ M3))):
                h = np.zeros(len(x) + 1, np.uint64)
                np.cumsum(x * _power(BASE, len(x)), out=h[1:])
                keys[k].append(mix((h[at[1:]] - h[at[:-1]]) * _power(INVERSE, len(x) + 1)[at[:-1]] + np.diff(at).astype(np.uint64)))
            for s in range(0, len(sets), 256):
                m = np.array([_minhash(x) for x in sets[s : s + 256]], np.uint64)
                m = mix(m + np.arange(1, HASHES + 1, dtype=np.uint64) * M1)  # each MinHash with its number
                band = m[:, :BANDED].reshape(len(m), BANDED // ROWS, ROWS)
                one = band[:, :, 0]
                for r in range(1, ROWS):
                    one = mix(one * M1 + band[:, :, r])
                bands.append(one)
                bit = (m >> np.uint64(40)).astype(np.int64) % BITS + np.arange(len(m))[:, None] * BITS
                odds.append(np.packbits((np.bincount(bit.ravel(), minlength=len(m) * BITS) & 1).astype(np.uint8)).view(np.int64).reshape(len(m), -1))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(signed(np.concatenate(k)) if k else [], pa.int64()) for k in keys], lists(signed(np.concatenate(bands))), lists(np.concatenate(odds))],
            names=["rid", "doc_id", "n", "k1", "k2", "bands", "sketch"])


def _shingled(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(b.column("text"))
        out = []
        for i, j in spans_of(ends):
            out += [s.tobytes() for s in _sets(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])[0]]
        yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(out, pa.binary())], names=["rid", "shingles"])


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(48)).astype(np.int64) % SLOTS


def _counted(batches):
    """How often the shingles of a slot occur in a task's sets."""
    import pyarrow as pa

    n = np.zeros(SLOTS, np.int64)
    for b in batches:
        for x in b.column("shingles"):
            n += np.bincount(_slot(np.frombuffer(x.as_buffer(), np.uint64)), minlength=SLOTS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])


def _rare(sent, percent: int):
    """The first shingles of each set, the rarest first: as many as two sets that meet the threshold can't both do without."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rid, out = [], []
            for r, x in zip(b.column("rid").to_pylist(), b.column("shingles"), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                first = s[np.argsort(sent.value[_slot(s)], kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]]
                rid.append(np.full(len(first), r, np.int64))
                out.append(signed(first))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid) if rid else [], pa.int64()), pa.array(np.concatenate(out) if out else [], pa.int64())], names=["rid", "bucket"])

    return run


def _confirm(percent: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                    ok.append(False)
                    continue
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def _across(percent: int):
    return lambda batches: _pairs_across(batches, percent)


def _pairs_across(batches, percent: int):
    """Rows (bucket, split, i, j, rid, n, comp, sketch, bands, block) in the order of (bucket, i, j): pairs of nodes of
    different components, one of block i and one of block j, whose sizes and sketches agree; each pair only in the
    first bucket that it shares, unless that was split. Of a block with too many only its bucket (dense)."""
    import pyarrow as pa

    most = most_ones(percent)

    def pairs(rid, comp, block, n, split, sk, bands, bucket, i, j):
        left, right = (np.arange(len(rid)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        out_a, out_b = [], []
        for c, e in ((c, e) for c in range(0, len(left), 256) for e in range(0, len(right), 256)):
            x, y = left[c : c + 256], right[e : e + 256]
            ok = comp[x][:, None] != comp[y][None, :]
            ok &= percent * np.maximum(n[x][:, None], n[y][None, :]) <= 100 * np.minimum(n[x][:, None], n[y][None, :])
            if i == j:
                ok &= x[:, None] < y[None, :]
            u, v = np.nonzero(ok)
            ones = np.bitwise_count((sk[x[u]] ^ sk[y[v]]).view(np.uint64)).sum(axis=1)
            u, v = x[u[ones < most]], y[v[ones < most]]
            first = (bands[u] == bands[v]).argmax(axis=1)
            own = (bands[u, first] == bucket) | split[u]
            a, b = rid[u[own]], rid[v[own]]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
        return out_a, out_b

    held, key = [], None
    cols = ("bucket", "i", "j")

    def flush(held):
        cols = [np.concatenate([h[k] for h in held]) for k in range(7)]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in pairs(*cols, *key))
        if len(a) > MANY * len(cols[0]):
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([key[0]], pa.int64())], names=["a", "b", "dense"])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "dense"])

    for batch in batches:
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in cols]
        rid, comp, block, n, split = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "comp", "block", "n", "split"))
        sk, bands = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, w) for c, w in (("sketch", BITS // 64), ("bands", BANDED // ROWS)))
        new = np.ones(len(rid), bool)
        new[1:] = (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])
        at = np.append(np.flatnonzero(new), len(rid))
        for s, e in zip(at[:-1], at[1:], strict=True):
            own = tuple(int(x[s]) for x in k)
            if own != key and held:
                yield flush(held)
                held = []
            key = own
            held.append((rid[s:e], comp[s:e], block[s:e], n[s:e], split[s:e], sk[s:e], bands[s:e]))
    if held:
        yield flush(held)


def _exactly(percent: int):
    """The same blocks with full sets: links that join components, as a forest."""
    most = most_ones(percent)

    def run(key, table):
        import pyarrow as pa

        i, j = (key[c].as_py() for c in (1, 2))
        rid, comp, block = (table.column(c).to_numpy() for c in ("rid", "comp", "block"))
        sk = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, BITS // 64).view(np.uint64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        n = np.array([len(s) for s in sets], np.int64)
        name, token = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(n)))
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out, mark = [], np.zeros(len(name), bool)
        right = np.flatnonzero(block == j)
        for u in np.flatnonzero(block == i):
            own = find(int(comp[u]))
            v = right[right > u] if i == j else right
            v = v[percent * np.maximum(n[u], n[v]) <= 100 * np.minimum(n[u], n[v])]
            v = v[np.bitwise_count(sk[v] ^ sk[u]).sum(axis=1) < most]
            v = v[np.array([find(int(c)) != own for c in comp[v]], bool)]
            if not len(v):
                continue
            mark[token[at[u] : at[u + 1]]] = True
            rows = np.repeat(at[v] - np.concatenate(([0], np.cumsum(n[v])[:-1])), n[v]) + np.arange(n[v].sum())
            both = np.add.reduceat(mark[token[rows]].astype(np.int64), np.concatenate(([0], np.cumsum(n[v])[:-1])))
            mark[token[at[u] : at[u + 1]]] = False
            for w in v[100 * both >= percent * (n[u] + n[v] - both)]:
                a, b = find(int(comp[u])), find(int(comp[w]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((min(rid[u], rid[w]), max(rid[u], rid[w])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _ones(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in edges (a, b): comp is the smallest node reachable.

    Each round every node takes the smallest label around it, then its label's label; labels only fall, and a round
    without a change ends it. Labels are written each round, which cuts the lineage.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = written(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) of all nodes after further links (a, b): the links' components are joined among each other,
    which is a graph of components, not of nodes."""
    label = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias("c" + c))
    between = links.join(label("a"), "a").join(label("b"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    over = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return written(comps.join(over, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "comps")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of docs (rid unique, doc_id, text): rid, doc_id, component (one number for each component), n_shingles and
    component_id, the smallest doc_id reachable."""
    spark = docs.sparkSession
    small_batches(spark)
    signs = written(docs.mapInArrow(_sign, "rid long, doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"), "signs")
    full = signs.where("n > 0")
    reps = written(full.groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("doc")), "reps")
    nodes = written(full.join(reps.select(F.col("rep").alias("rid")), "rid").select("rid", "n", "bands", "sketch"), "nodes")
    in_bands = nodes.select("rid", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = written(in_bands.join(shared, "bucket"), "members")
    side = lambda a: nodes.select(F.col("rid").alias(a), F.col("n").alias("n" + a), F.col("sketch").alias("s" + a))

    some = member.select("rid").distinct()
    sets = bucketed(docs.select("rid", "text").join(some, "rid").select("rid", "text").mapInArrow(_shingled, "rid long, shingles binary"), "rid", "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")), "a")
        p = p.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")), "b")
        return written(p.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long"), "links")

    def still_open(comps: DataFrame) -> DataFrame:
        """Members (bucket, size, rid, comp) of buckets that hold several components."""
        m = member.join(comps.withColumnRenamed("node", "rid"), "rid")
        split = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        return written(m.join(split, "bucket"), "open")

    comps, hubs = nodes.select(F.col("rid").alias("node"), F.col("rid").alias("comp")), None
    m = still_open(comps)
    while True:
        fresh = m
        if hubs is not None:  # not from the component of the last hub
            last = hubs.join(comps.select(F.col("node").alias("hub"), F.col("comp").alias("last")), "hub").select("bucket", "last")
            fresh = m.join(last, "bucket", "left").where("last is null or comp <> last").drop("last")
        hubs = written(fresh.groupBy("bucket").agg(F.min(F.struct("rid", "comp")).alias("x")).select("bucket", F.col("x.rid").alias("hub"), F.col("x.comp").alias("hub_comp")), "hubs")
        stars = m.join(hubs, "bucket").where("comp <> hub_comp").select(F.least("hub", "rid").alias("a"), F.greatest("hub", "rid").alias("b")).distinct()
        stars = stars.join(side("a"), "a").join(side("b"), "b")
        stars = stars.where(F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100).where(_ones(F.col("sa"), F.col("sb")) < most_ones(percent)).select("a", "b")
        links = confirmed(stars)
        found, before = links.count(), m.count()
        if found:
            comps, hubs = joined(comps, links), hubs.drop("hub_comp")
            m = still_open(comps)
        if found * PAYS <= before:  # the rest is compared at once, whatever is left
            break

    # m holds the buckets with several components still. Nodes of hot ones meet at a rare shingle instead.
    hot = written(m.where(F.col("size") > HOT).select("rid", "comp").distinct(), "hot")
    own = sets.join(hot.select("rid"), "rid", "left_semi")
    often = np.zeros(SLOTS, np.int64)
    counts = own.select("shingles").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    first = own.select("rid", "shingles").mapInArrow(_rare(spark.sparkContext.broadcast(often), percent), "rid long, bucket long").join(hot, "rid")
    first = written(first, "rare")
    parts = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "size")
    hot = first.join(parts, "bucket").select("bucket", "size", "rid", "comp", F.lit(True).alias("split"))
    m = m.where(F.col("size") <= HOT).select("bucket", "size", "rid", "comp", F.lit(False).alias("split")).unionByName(hot)

    def blocks(m: DataFrame, nb: Column) -> DataFrame:
        """Members with their block of nb, once for each pair (i, j) of blocks that has it."""
        m = m.withColumn("block", F.pmod(F.xxhash64("rid"), nb).cast("int"))
        return m.withColumn("_o", F.explode(F.sequence(F.lit(0), nb - 1))).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")})

    each = blocks(m, F.ceil(F.col("size") / BLOCK).cast("int")).join(nodes, "rid").select("bucket", "split", "i", "j", "rid", "n", "comp", "sketch", "bands", "block")
    each = each.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = written(each.mapInArrow(_across(percent), "a long, b long, dense long"), "pairs")
    more = confirmed(found.where("dense is null").select("a", "b").distinct())
    if more.limit(1).count():
        comps = joined(comps, more)
    dense = m.join(found.where("dense is not null").select(F.col("dense").alias("bucket")).distinct(), "bucket").select("bucket", "rid")
    dense = written(dense.join(comps.withColumnRenamed("node", "rid"), "rid").join(nodes.select("rid", "n", "sketch"), "rid"), "dense")
    wide = dense.groupBy("bucket").agg(F.ceil(F.sum("n") / SETS).cast("int").alias("nb"))
    dense = blocks(dense.join(wide, "bucket"), F.col("nb")).join(sets, "rid").select("bucket", "i", "j", "rid", "comp", "block", "sketch", "shingles")
    more = written(dense.groupBy("bucket", "i", "j").applyInArrow(_exactly(percent), "a long, b long"), "links")
    if more.limit(1).count():
        comps = joined(comps, more)

    of = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    of = written(of, "of")
    least = of.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of = of.join(least, "comp").select("k1", "k2", "component_id", "comp")
    out = signs.select("rid", "doc_id", "n", "k1", "k2").join(of, ["k1", "k2"], "left")
    return out.select("rid", "doc_id", F.coalesce("comp", "rid").alias("component"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the smallest doc_id that links of at least 85 % lead to.

    Cases: a null or blank text has an empty set, is linked with nothing and kept; a text under five words has its
    whole sequence as one shingle; a text of any length is read whole; equal texts (ties) are one node; rows with a null doc_id link like others but give no component its id (a component
    of such rows only has a null id, and they are kept); rows that repeat a doc_id get its component each; further
    columns are ignored; an empty table gives no rows.
    """
    docs, _ = keyed(table(spark, sf_dir, "documents"), "op8")
    out = near_duplicates(docs)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
