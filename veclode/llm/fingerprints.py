"""Repeated word windows by a log-structured fingerprint index.

The index holds fingerprints of five-word grams, chosen so that each window of 13 words has exactly one: the least of
its nine grams (leftmost on ties), which equal windows choose alike. It lives in a folder: runs, immutable sorted tables
bucketed by fingerprint so that a merge needs no shuffle; the texts, compressed, bucketed by document; and a manifest that
lists the runs, by which a later session opens it. A run has two tables: fingerprints with their document, and hashes of
windows that were verified before with the first document of each. To append a batch of documents means

1. to fingerprint it, sort, and write the result as a run;
2. to merge-join the run with each older one, bucket by bucket: what both have, or the batch has twice, is a hit;
3. to verify hits: the texts of hit documents, new and old, are read, windows whose gram was hit are named by 64 and by
   32 bits of independent names of all their 13 words, and merge-joined with the windows of older runs and with each
   other. Windows equal in both names, that an earlier document has, are removed; all go to the run;
4. to list the run in the manifest.

Before the next batch the two newest runs are compacted to one as long as they have the same level, like digits of a
binary counter. A fingerprint that several documents have is kept without a document then: their windows are among the
verified ones. Documents of earlier batches come first; in a batch those with a smaller ``doc``.

Entries travel as packed sorted arrays, byte planes compressed, a few bytes each. What many documents share is decided
inside the chunk that read them where it can be: a chunk sends at most one entry a fingerprint, so no bucket receives the
copies of a window, only chunks that have it.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTES, M1, M2, M3, bucketed, keyed, mix, n_words, reopened, scratch_dir, small_batches, spans_of, squeezed, table, texts, unzipped, written, zipped

WINDOW, GRAM, BATCHES = 13, 5, 4
#: Entries that a chunk gathers before it sorts and sends them, and bytes of text a bucket stands for.
CHUNK, BUCKET_BYTES = 1 << 20, 16 << 20
LOW = np.uint64(0xFFFFFFFF)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Powers of an odd base and of its inverse modulo 2**64, for prefix sums whose differences name words.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 20), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def word_names(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the words of texts laid end to end, where each begins and ends, and how many words begin before each text."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(ends), np.int64)
    word = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    a = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    b = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * _power(BASE, len(raw)), out=h[1:])
    name = mix((h[b] - h[a]) * _power(INVERSE, len(raw))[a] + (b - a).astype(np.uint64))
    return name, a, b, np.searchsorted(a, ends)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    k, n = 1, len(v) - w + 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[:n], v[w - k : w - k + n])


def sequence_names(name: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Names of every k consecutive words."""
    out = np.full(max(len(name) - k + 1, 0), salt, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * M1 + name[i : len(name) - k + 1 + i] * M2
    return mix(out)


def windows(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with words name[at[i]:at[i + 1]]: the first words of all windows, the text of each, and its gram's name."""
    grams = sequence_names(name, GRAM, 5)
    n = np.maximum(np.diff(at) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    if not len(doc):
        return doc, doc, grams[:0]
    p = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + at[:-1][doc]
    v = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    return p, doc, grams[(_least(v, WINDOW - GRAM + 1)[p] & LOW).astype(np.int64)]


def _first(*cols: np.ndarray) -> np.ndarray:
    """Marks the first of each group of equal rows of sorted columns."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def _groups(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal rows of sorted columns begins, and how many rows it has."""
    at = np.flatnonzero(_first(*cols))
    return at, np.diff(np.append(at, len(cols[0])))


def _slices(col: np.ndarray, at: np.ndarray, size: np.ndarray):
    import pyarrow as pa

    return pa.array([_pack(col[i : i + n]) for i, n in zip(at, size, strict=True)], pa.binary())


def _pack(x: np.ndarray) -> bytes:
    """Numbers as bytes: their first bytes, then their second ones and so on, compressed, after the number of bytes."""
    import pyarrow as pa

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(planes).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(b[:4], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[4:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


COLUMNS = "abcde"
PACKED = "kind int, part int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def _packed(kind: int, part: np.ndarray, *cols: np.ndarray):
    """A row (kind, part, packed columns) for each part of entries that has any; part: that of each entry."""
    import pyarrow as pa

    order = np.argsort(part, kind="stable")
    at, size = _groups(part := part[order])
    arrays = [_slices(c[order], at, size) for c in cols]
    arrays += [pa.nulls(len(at), pa.binary())] * (len(COLUMNS) - len(arrays))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(part[at].astype(np.int32)), *arrays], names=["kind", "part", *COLUMNS])


def _open(table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[_unpack(x, kind) for x in table.column(name).to_pylist() if x is not None]])


def _part(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.int64) * n >> 32


def _home(rid: np.ndarray, n: int) -> np.ndarray:
    """The part that gathers what is found about a document."""
    return _part(mix(rid.astype(np.uint64) * M3), n)


def _fingerprint(parts: int):
    """Batches (rid, text) to packed entries: kind 0 (fingerprint, document or -1 where the chunk has several), by
    fingerprint; kind 1 (document, fingerprint) of those several, by document."""

    def chunk(fps: list, rids: list):
        f, r = np.concatenate(fps), np.concatenate(rids)
        order = np.lexsort((r, f))
        f, r = f[order], r[order]
        new = _first(f, r)
        f, r = f[new], r[new]
        first, size = _groups(f)
        many = np.repeat(size > 1, size)
        yield _packed(0, _part(f[first], parts), f[first], np.where(size > 1, -1, r[first]))
        yield _packed(1, _home(r[many], parts), r[many], f[many])

    def run(batches):
        fps, rids, n = [], [], 0
        for b in batches:
            raw, ends = texts(b.column("text"))
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            for i, j in spans_of(ends):
                name, _, _, at = word_names(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                _, doc, gram = windows(name, at)
                new = _first(doc, gram)
                fps.append(gram[new])
                rids.append(rid[i:j][doc[new]])
                n += len(fps[-1])
            if n >= CHUNK:
                yield from chunk(fps, rids)
                fps, rids, n = [], [], 0
        if n:
            yield from chunk(fps, rids)

    return run


def _entries(key, table, kind: int):
    """Fingerprints and documents of a bucket's rows of a kind, sorted."""
    import pyarrow.compute as pc

    t = table.filter(pc.equal(table.column("kind"), kind))
    f, r = _open(t, "a", np.uint64), _open(t, "b", np.int64)
    order = np.argsort(f, kind="stable")
    return f[order], r[order]


def _hits(parts: int, f: np.ndarray, r: np.ndarray):
    return _packed(1, _home(r[r >= 0], parts), r[r >= 0], f[r >= 0])


def _run(parts: int):
    """A batch's entries of a bucket as a run (kind 2), and hits inside the batch (kind 1). A run keeps the document of
    a fingerprint that only one has, so that a later batch can call it up; those of several were hits already."""

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        f, r = _entries(key, table, 0)
        at, n = _groups(f)
        several = np.repeat(n > 1, n)
        new = _packed(2, np.full(len(at), key[0].as_py()), f[at], np.where(n > 1, -1, r[at]))
        known = table.filter(pc.equal(table.column("kind"), 1))
        return pa.concat_tables([known, pa.Table.from_batches([new, _hits(parts, f[several], r[several])])])

    return run


def _meet(parts: int):
    """Hits between two runs of a bucket."""

    def run(key, left, right):
        import pyarrow as pa

        (f, r), (g, s) = _entries(key, left, 2), _entries(key, right, 2)
        _, i, j = np.intersect1d(f, g, assume_unique=True, return_indices=True)
        return pa.Table.from_batches([_hits(parts, np.concatenate((f[i], g[j])), np.concatenate((r[i], s[j])))])

    return run


def _compact(key, left, right):
    """Two runs of a bucket as one."""
    import pyarrow as pa

    (f, r), (g, s) = _entries(key, left, 2), _entries(key, right, 2)
    f, r = np.concatenate((f, g)), np.concatenate((r, s))
    order = np.argsort(f, kind="stable")
    at, n = _groups(f := f[order])
    return pa.Table.from_batches([_packed(2, np.full(len(at), key[0].as_py()), f[at], np.where(n > 1, -1, r[order][at]))])


class Run(NamedTuple):
    level: int
    fps: str  # folders of its two tables
    windows: str
    batches: str  # names of the batches whose entries it has


MANIFEST = "version int, parts int, buckets int, level int, fps string, windows string, batches string"
TEXTS = "rid long, doc long, batch string, size int, zipped binary"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Index:
    """The fingerprint index in a folder, opened by its manifest if it has one, else new with ``parts`` buckets of entries.

    ``append`` a batch of documents (rid, doc, text), unique: rid is doc; it returns (rid, places): first words, packed, of
    windows that an earlier document has. A document of an earlier batch may come again with places known before.

    A batch counts from the moment the manifest lists it. What a lost driver leaves behind is not listed, neither runs nor
    texts, and the batch is appended again as if nothing had been.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 16, unique: bool = True) -> None:
        self.spark, self.root, self.parts, self.unique = spark, root.rstrip("/"), parts, unique
        self.runs: list[Run] = []
        self.version, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        if exists(spark, f"{self.root}/manifest"):
            rows = spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
            last = rows.agg(F.max("version")).first()[0]
            for r in rows.where(F.col("version") == last).orderBy(F.desc("level"), "fps").collect():  # a row a run: their number is logarithmic
                self.version, self.parts, self.buckets = r["version"], r["parts"], r["buckets"]
                self.runs.append(Run(r["level"], r["fps"], r["windows"], r["batches"]))

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        bucketed(rows, "part", name, self.buckets, path)
        return path

    def _open(self, path: str) -> DataFrame:
        return reopened(self.spark, path, PACKED, "part", self.buckets)

    def texts(self) -> DataFrame:
        """All texts of the index (rid, doc, size, zipped), bucketed by rid. A file holds one batch, so those of a batch that
        isn't listed aren't read."""
        return self._texts_of([b for run in self.runs for b in run.batches.split(",")])

    def _texts_of(self, batches: list[str]) -> DataFrame:
        return reopened(self.spark, f"{self.root}/texts", TEXTS, "rid", self.buckets).where(F.col("batch").isin(batches)).drop("batch")

    def _list(self) -> None:
        self.version += 1
        rows = [(self.version, self.parts, self.buckets, *run) for run in self.runs]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def compact(self) -> None:
        """Merge the newest runs while they have the same level. Old tables stay for readers of older manifests."""
        while len(self.runs) > 1 and self.runs[-1].level == self.runs[-2].level:
            new, old = self.runs.pop(), self.runs.pop()
            merged = lambda x, y, f: self._open(x).groupBy("part").cogroup(self._open(y).groupBy("part")).applyInArrow(f, PACKED)
            self.runs.append(Run(new.level + 1, self._write(merged(old.fps, new.fps, _compact), "fps"), self._write(merged(old.windows, new.windows, _compact_windows), "windows"), f"{old.batches},{new.batches}"))
            self._list()

    def append(self, batch: DataFrame) -> DataFrame:
        self.compact()
        batch = batch.select("rid", "doc", "text")
        entries = batch.select("rid", "text").mapInArrow(_fingerprint(self.parts), PACKED)
        fps = self._write(entries.groupBy("part").applyInArrow(_run(self.parts), PACKED), "fps")
        own = self._open(fps)
        hits = own.where("kind = 1")
        for old in self.runs:
            hits = hits.unionByName(own.groupBy("part").cogroup(self._open(old.fps).groupBy("part")).applyInArrow(_meet(self.parts), PACKED))
        asked = bucketed(hits.select("part", "a", "b").groupBy("part").applyInArrow(_gather, "rid long, fps binary"), "rid", "asked", self.buckets)
        name = self._keep(batch)
        held = self._texts_of([name, *(b for run in self.runs for b in run.batches.split(","))]).join(asked.hint("shuffle_hash"), "rid").select("rid", "doc", "size", "zipped", "fps")
        named = bucketed(held.mapInArrow(_name_windows(self.parts, self.unique), PACKED), "part", "named", self.buckets)
        windows = self._write(named.groupBy("part").applyInArrow(_verify(self.parts, self.unique), PACKED), "windows")
        gone = self._open(windows).where("kind = 1")
        for old in self.runs:
            gone = gone.unionByName(named.groupBy("part").cogroup(self._open(old.windows).groupBy("part")).applyInArrow(_older(self.parts, self.unique), PACKED))
        places = written(gone.select("part", "a", "b").groupBy("part").applyInArrow(_places, "rid long, places binary"), "places")
        self.runs.append(Run(0, fps, windows, name))
        self._list()
        return places

    def _keep(self, batch: DataFrame) -> str:
        """The batch's name, under which its texts are in the folder now."""
        name = uuid.uuid4().hex
        at = f"veclode_texts_{name}"
        self.spark.sql(f"CREATE TABLE {at} ({TEXTS}) USING parquet CLUSTERED BY (rid) INTO {self.buckets} BUCKETS LOCATION '{self.root}/texts'")
        zipped(batch.select("rid", "doc", F.lit(name).alias("batch"), "text")).write.mode("append").format("parquet").bucketBy(self.buckets, "rid").saveAsTable(at)
        self.spark.sql(f"DROP TABLE {at}")
        return name


def _gather(key, table):
    """(rid, packed sorted fingerprints) from hits of one part."""
    import pyarrow as pa

    r, f = _open(table, "a", np.int64), _open(table, "b", np.uint64)
    order = np.lexsort((f, r))
    r, f = r[order], f[order]
    new = _first(r, f)
    r, f = r[new], f[new]
    at, n = _groups(r)
    return pa.table([pa.array(r[at]), _slices(f, at, n)], names=["rid", "fps"])


def _name_windows(parts: int, unique: bool):
    """Batches (rid, doc, text, fps) to packed entries of windows whose gram was hit: kind 0 (two names, the chunk's
    smallest document, word, and rid unless it is that document) by name, kind 1 (rid, word) of windows that a smaller
    document of the chunk has."""

    def chunk(got: list):
        h, g, d, r, p = (np.concatenate([x[i] for x in got]) for i in range(5))
        order = np.lexsort((d, g, h))
        h, g, d, r, p = h[order], g[order], d[order], r[order], p[order]
        first, size = _groups(h, g)
        same = d == np.repeat(d[first], size)  # several rows where a document has the window twice
        cols = [x[same] for x in (h, g, d, p, *([] if unique else [r]))]
        yield _packed(0, _part(cols[0], parts), *cols)
        yield _packed(1, _home(r[~same], parts), r[~same], p[~same])

    def run(batches):
        got, n = [], 0
        for b in batches:
            raw, ends = texts(unzipped(b))
            rid, doc_id = (b.column(x).to_numpy(zero_copy_only=False) for x in ("rid", "doc"))
            fps = b.column("fps").to_pylist()
            for i, j in spans_of(ends):
                name, _, _, at = word_names(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                p, doc, gram = windows(name, at)
                if not len(p):
                    continue
                hit = np.zeros(len(p), bool)
                lim = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(j - i):
                    x = _unpack(fps[i + k], np.uint64)
                    y = gram[lim[k] : lim[k + 1]]
                    hit[lim[k] : lim[k + 1]] = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                p, doc = p[hit], doc[hit]
                got.append((sequence_names(name, WINDOW, 13)[p], (sequence_names(name, WINDOW, 31)[p] >> np.uint64(32)).astype(np.uint32), doc_id[i:j][doc], rid[i:j][doc], (p - at[:-1][doc]).astype(np.int32)))
                n += len(p)
            if n >= CHUNK:
                yield from chunk(got)
                got, n = [], 0
        if n:
            yield from chunk(got)

    return run


def _named(table, unique: bool):
    """Columns of named windows: two names, document, word, rid."""
    import pyarrow.compute as pc

    table = table.filter(pc.equal(table.column("kind"), 0))
    h, g, d, w = (_open(table, c, k) for c, k in zip("abcd", (np.uint64, np.uint32, np.int64, np.int32), strict=True))
    return h, g, d, w, d if unique else _open(table, "e", np.int64)


def _seen(table):
    """Columns of verified windows of a run: two names and the first document."""
    import pyarrow.compute as pc

    table = table.filter(pc.equal(table.column("kind"), 3))
    return tuple(_open(table, c, k) for c, k in zip("abc", (np.uint64, np.uint32, np.int64), strict=True))


def _verify(parts: int, unique: bool):
    """Of a part's windows: (rid, word) of each that a smaller document of the batch has too, by document; what is known
    already; and all windows with their first document (kind 3), sorted."""

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        known = table.filter(pc.equal(table.column("kind"), 1))
        h, g, d, w, r = _named(table, unique)
        order = np.lexsort((d, g, h))
        h, g, d, w, r = (x[order] for x in (h, g, d, w, r))
        first, size = _groups(h, g)
        out = d > np.repeat(d[first], size)
        kept = _packed(3, np.full(len(first), key[0].as_py()), h[first], g[first], d[first])
        return pa.concat_tables([known, pa.Table.from_batches([_packed(1, _home(r[out], parts), r[out], w[out]), kept])])

    return run


def _older(parts: int, unique: bool):
    """Of a part's windows: (rid, word) of each that an older run has with a smaller document."""

    def run(key, left, right):
        import pyarrow as pa

        h, g, d, w, r = _named(left, unique)
        h0, g0, d0 = _seen(right)
        n = len(h0)
        ah, ag, at = np.concatenate((h0, h)), np.concatenate((g0, g)), np.arange(n + len(h))
        order = np.lexsort((at, ag, ah))
        first, size = _groups(ah[order], ag[order])
        lead = np.repeat(order[first], size)  # a run has a window once, before all new ones
        hit = (order >= n) & (lead < n)
        i, d1 = order[hit] - n, d0[lead[hit]]
        i = i[d[i] > d1]
        return pa.Table.from_batches([_packed(1, _home(r[i], parts), r[i], w[i])])

    return run


def _compact_windows(key, left, right):
    """Verified windows of two runs as one's, each with its first document."""
    import pyarrow as pa

    h, g, d = (np.concatenate(x) for x in zip(_seen(left), _seen(right), strict=True))
    order = np.lexsort((d, g, h))
    first, _ = _groups(h[order], g[order])
    i = order[first]
    return pa.Table.from_batches([_packed(3, np.full(len(i), key[0].as_py()), h[i], g[i], d[i])])


def _places(key, table):
    """(rid, packed first words of windows to remove) of one part."""
    import pyarrow as pa

    r, w = _open(table, "a", np.int64), _open(table, "b", np.int32)
    order = np.lexsort((w, r))
    r, w = r[order], w[order]
    at, n = _groups(r)
    return pa.table([pa.array(r[at]), _slices(w, at, n)], names=["rid", "places"])


def _cut(batches):
    import pyarrow as pa

    for b in batches:
        gone, sha = [], []
        for text, places in zip(unzipped(b).to_pylist(), b.column("places").to_pylist(), strict=True):
            ws = text.encode().split()
            p = np.concatenate([_unpack(x, np.int32) for x in places])
            m = np.zeros(len(ws) + 1, np.int32)
            np.add.at(m, p, 1)
            np.add.at(m, p + WINDOW, -1)
            drop = np.cumsum(m)[:-1] > 0
            gone.append(int(drop.sum()))
            sha.append(hashlib.sha256(b" ".join(ws[k] for k in np.flatnonzero(~drop))).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["rid", "n_removed", "kept"])


def parts_of(docs: DataFrame, least: int) -> int:
    """Buckets for the index: in proportion to the text, so that what a bucket gathers is bounded."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, int(n // BUCKET_BYTES) + 1)


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs in n batches by ascending document: the history of an index that is filled bit by bit."""
    at = docs.agg(F.percentile_approx("doc", [k / n for k in range(1, n)], 1000).alias("x")).first()["x"] or []
    at = sorted(set(at))
    lows, highs = [None, *at], [*at, None]
    return [docs.where((F.lit(True) if a is None else F.col("doc") > a) & (F.lit(True) if b is None else F.col("doc") <= b)) for a, b in zip(lows, highs, strict=True)]


def op5_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that a document with a smaller doc_id has too are removed. The index is filled in batches
    of ascending doc_id, as a corpus that grows would fill it.

    Cases: a null or blank text has no words; texts under 13 words lose nothing; a text of any length is read whole, one
    at a time where it is longer than a batch; a null doc_id counts as larger than all others; rows with one doc_id are no
    smaller than each other, so they lose nothing to each other (ties); further columns are ignored; an empty table
    gives no rows.
    """
    small_batches(spark)
    docs, unique = keyed(table(spark, sf_dir, "documents"), "op5")
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(2**63 - 1)))
    index = Index(spark, f"{scratch_dir(spark)}/veclode/index-{uuid.uuid4().hex}", parts_of(docs, 16), unique)
    gone = None
    for batch in batches_of(docs, BATCHES):
        found = index.append(batch)
        gone = found if gone is None else gone.unionByName(found)
    gone = bucketed(gone.groupBy("rid").agg(F.collect_list("places").alias("places")), "rid", "places", index.buckets)
    cut = index.texts().join(gone.hint("shuffle_hash"), "rid").select("rid", "size", "zipped", "places").mapInArrow(_cut, "rid long, n_removed long, kept string")
    all_ = docs.select("rid", "doc_id", n_words(F.col("text")).alias("n_words"), F.sha2(squeezed(F.col("text")), 256).alias("whole"))
    out = all_.join(cut, "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))
