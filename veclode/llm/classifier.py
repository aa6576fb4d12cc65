"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on the quality of every text; the labels table's quality votes too, as one
more labeller. Expectation-maximisation finds how often each labeller votes what on bad and on good texts, from nothing
but how often each pattern of votes occurs (a table of at most 3 ** labellers rows, counted over all documents), and
with that the posterior of each pattern; where a label is known it fixes the posterior. A hashed linear scorer has two
targets. Quality trains on posteriors, of documents with and without a label alike; toxicity, of which no heuristic
speaks, on the documents with a toxic label. The rows that train are all labelled documents (where there are more than
``SAMPLE``, a hash sample of about that many) and a hash sample of ``UNLABELLED`` others. The scorer judges every
document by the worse of its two scores.

Its features are hashed: every word, the first 4 and 6 bytes of words that occur once, twice, three times or more, and the
heuristics' votes. A feature has a weight if it goes with a class beyond chance (``SURE`` deviations, seen ``SEEN``
times); their number is not capped. What is counted for that, and for the training rows, is sent as weighed features only.

Cases: a null or blank text has no words and is rejected (too short); a text of any length is read whole, one text at a
time where it is longer than a batch; a document labelled more than once counts by its mean labels, a label that is null
not at all; without labels the heuristics alone decide; repeated rows and ties get the same score; scores at 0.5 are
rejected; further columns, of labels too, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import M1, M2, keyed, mix, small_batches, spans_of, table, texts, written
from .decontaminate import PLAIN
from .fingerprints import word_names

#: Bits of a feature's slot; labelled and other rows that train at most (about: they are told by hash).
SLOT_BITS, SAMPLE, UNLABELLED = 20, 20000, 10000
SLOTS = 1 << SLOT_BITS
#: What texts without a label weigh in the label model beside those with one.
UNSURE = 0.1
#: Deviations from chance and rows from which a feature gets a weight; steps of the descent.
SURE, SEEN, ROUNDS = 4.0, 4, 300
PREFIXES, LEVELS = (4, 6), 3
BAD, GOOD, NONE = 2, 1, 0
HEURISTICS = ("capitals", "bangs", "symbols", "variety", "length")
TARGETS = ("quality", "toxic")
GOLD = 3 ** len(HEURISTICS)
_UPPER, _BANG, _SYMBOL, _LETTER = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = 1
_BANG[33] = 1
_SYMBOL[list(b"#*$%&|<>")] = 1


def _vote(x: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Bad from ``bad`` up, good up to ``good``."""
    return np.where(x >= bad, BAD, np.where(x <= good, GOOD, NONE))


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _level(slot: np.ndarray, level: int) -> np.ndarray:
    """The slot of a prefix that occurs at least ``level`` + 1 times, from that of the prefix."""
    return (slot + level * 0x9E375) % SLOTS


def _read(raw: np.ndarray, ends: np.ndarray):
    """Of each text: its votes as one number in base 3, and how many words come before it; of all words in order: their
    slots and their text; of all prefixes: the same."""
    plain = PLAIN[raw]
    name, a, b, at = word_names(plain, ends)
    n = np.maximum(np.diff(at), 1)
    word = _slot(name)

    def total(values):
        c = np.concatenate(([0], np.cumsum(values[raw])))
        return c[ends[1:]] - c[ends[:-1]]

    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    distinct = np.bincount(np.unique(doc * SLOTS + word) // SLOTS, minlength=len(at) - 1) if len(doc) else np.zeros(len(at) - 1)
    few = np.diff(at) < 50
    votes = [
        _vote(total(_UPPER) / np.maximum(total(_LETTER), 1), 0.2, 0.5),
        _vote(total(_BANG) / n, 0.05, 0.3),
        _vote(total(_SYMBOL) / n, 0.05, 0.2),
        np.where(few, NONE, _vote(1 - distinct / n, 0.6, 0.75)),
        np.where(np.diff(at) < 10, BAD, NONE),
    ]
    slots, docs = [], []
    for k in PREFIXES:
        long = np.flatnonzero(b - a > k)
        x = np.full(len(long), k, np.uint64)
        for i in range(k):
            x = (x << np.uint64(8)) | plain[a[long] + i].astype(np.uint64)
        slots.append(_slot(mix(x * M1 + M2)))
        docs.append(doc[long])
    return sum(v * 3**k for k, v in enumerate(votes)), at, word, doc, np.concatenate(slots), np.concatenate(docs)


def _features(word, doc, prefix, owner) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) of all features."""
    one, n = np.unique(owner * SLOTS + prefix, return_counts=True)
    d, s = one // SLOTS, one % SLOTS
    all_ = [np.unique(doc * SLOTS + word)] + [d[n > k] * SLOTS + _level(s[n > k], k) for k in range(LEVELS)]
    both = np.unique(np.concatenate(all_))
    return both // SLOTS, both % SLOTS


def _votes(batches):
    import pyarrow as pa

    for b in batches:
        raw, ends = texts(b.column("text"))
        votes = [_read(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])[0] for i, j in spans_of(ends)]
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(np.concatenate(votes) if votes else [], pa.int32())], names=["rid", "doc_id", "votes"])


def _seen(batches):
    """Of the training rows of a task: for each slot how many rows of each target have it, and their sum of posteriors."""
    import pyarrow as pa

    counts = np.zeros((4, SLOTS))
    for b in batches:
        raw, ends = texts(b.column("text"))
        y = [b.column(t).to_numpy(zero_copy_only=False) for t in TARGETS]
        for i, j in spans_of(ends):
            d, s = _features(*_read(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])[2:])
            for k in range(2):
                p = y[k][i:j][d]
                ok = ~np.isnan(p)
                counts[2 * k] += np.bincount(s[ok], minlength=SLOTS)
                counts[2 * k + 1] += np.bincount(s[ok], weights=p[ok], minlength=SLOTS)
    at = np.flatnonzero(counts[0] + counts[2])
    yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c[at]) for c in counts]], names=["slot", "n0", "y0", "n1", "y1"])


def _weighed(sent):
    """The chosen features of each training row, as their numbers."""

    def run(batches):
        import pyarrow as pa

        to = np.full(SLOTS, -1)
        to[sent.value] = np.arange(len(sent.value))
        for b in batches:
            raw, ends = texts(b.column("text"))
            found = []
            for i, j in spans_of(ends):
                d, s = _features(*_read(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])[2:])
                k = to[s]
                d, k = d[k >= 0], k[k >= 0].astype(np.int32)
                cut = np.searchsorted(d, np.arange(j - i + 1))
                found += [k[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            keep = ["rid", "votes", *TARGETS]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(found, pa.binary())], names=[*keep, "found"])

    return run


def label_model(counts: dict[int, int], labellers: int, rounds: int = 200) -> tuple[dict[int, float], list, float]:
    """EM for labellers that are independent given the class. counts: documents by pattern of votes (base 3).

    Returns the posterior of "bad" of each pattern, for each labeller the chances of (nothing, good, bad) on good and
    on bad texts, and the share of bad texts. It starts from majorities, and the last labeller (labels) decides alone
    where it votes; that it doesn't vote says nothing, as texts are labelled at random. Where there are labels, texts
    without one weigh ``UNSURE`` times as much in all, or the largest kind of bad text would become the whole class.
    """
    digits = {p: [p // 3**k % 3 for k in range(labellers)] for p in counts}

    def start(d):
        if d[-1] != NONE:
            return 0.99 if d[-1] == BAD else 0.01
        return 0.9 if BAD in d[:-1] else 0.1

    post = {p: start(d) for p, d in digits.items()}
    known = sum(n for p, n in counts.items() if digits[p][-1] != NONE)
    weight = min(1.0, UNSURE * known / max(1, sum(counts.values()) - known)) if known else 1.0
    table, prior = [], 0.5
    for _ in range(rounds if counts else 0):
        table = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in range(labellers)]
        total = [1.0, 1.0]
        for p, n in counts.items():
            n = n if digits[p][-1] != NONE else n * weight
            for y, q in ((1, post[p]), (0, 1 - post[p])):
                total[y] += n * q
                for k, v in enumerate(digits[p]):
                    table[k][y][v] += n * q
        table = [[[x / sum(row) for x in row] for row in t] for t in table]
        prior = total[1] / sum(total)
        new = {}
        for p, d in digits.items():
            if d[-1] != NONE:  # a label is known, not estimated
                new[p] = post[p]
                continue
            z = math.log(prior / (1 - prior)) + sum(math.log(table[k][1][v] / table[k][0][v]) for k, v in enumerate(d[:-1]))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        moved = max((abs(new[p] - post[p]) for p in post), default=0)
        post = new
        if moved < 1e-9:
            break
    return post, table, prior


def beyond_chance(n: str, y: str, p: float) -> Column:
    """Whether a slot goes with one class: n rows have it, y is their sum of posteriors, p the mean of all rows."""
    z = (F.col(y) - F.col(n) * p) / F.sqrt(F.greatest(F.col(n) * (p * (1 - p)), F.lit(1e-9)))
    return (F.col(n) >= SEEN) & (F.abs(z) > SURE)


def train(found: list[np.ndarray], votes: np.ndarray, y: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by feature, weights by (heuristic, vote), bias: logistic regression on soft labels y.

    found: the features that each row has, as numbers under ``features``; votes: its votes as a number in base 3.
    """
    k = len(HEURISTICS)
    if not len(y):
        return np.zeros(features), np.zeros((k, 3)), -30.0
    rows = len(y)
    each = np.arange(rows, dtype=np.int32)
    row = np.concatenate([np.repeat(each, [len(x) for x in found]), np.repeat(each, k)])
    vote = votes[:, None] // 3 ** np.arange(k) % 3 + np.arange(k) * 3 + features
    col = np.concatenate([*found, vote.ravel().astype(np.int32)])
    n = features + 3 * k
    x, m, s = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, ROUNDS + 1):  # Adam on all rows, with a small ridge
        score = np.bincount(row, weights=x[col], minlength=rows) + x[n]
        e = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / rows
        g = np.append(np.bincount(col, weights=e[row], minlength=n), e.sum()) + 1e-5 * x
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return x[:features], x[features:n].reshape(k, 3), float(x[n])


def _trained(own: list[np.ndarray]):
    """Weights of each target from all training rows; own: which features a target uses."""

    def run(batches):
        import pyarrow as pa

        votes, y, found = [], [], []
        for b in batches:
            votes.append(b.column("votes").to_numpy(zero_copy_only=False))
            y.append([b.column(t).to_numpy(zero_copy_only=False) for t in TARGETS])
            found += [np.frombuffer(x.as_buffer(), np.int32).copy() for x in b.column("found")]
        votes = np.concatenate([np.zeros(0, np.int64), *votes]).astype(np.int64)
        for k in range(len(TARGETS)):
            p = np.concatenate([np.zeros(0), *[x[k] for x in y]])
            to = np.where(own[k], np.cumsum(own[k]) - 1, -1).astype(np.int32)
            use = np.flatnonzero(~np.isnan(p))
            w = np.zeros(len(to))
            w[own[k]], by_vote, bias = train([to[f][to[f] >= 0] for f in (found[i] for i in use)], votes[use], p[use], int(own[k].sum()))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([by_vote.ravel().tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["target", "weights", "by_vote", "bias"])

    return run


def scores(model, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[target][text] log odds of bad; model: slots and, for each target, their weights, weights of votes and bias."""
    slots, parts = model
    votes, at, word, doc, prefix, owner = _read(raw, ends)
    n = len(ends) - 1
    has = np.zeros(SLOTS, bool)
    has[slots] = True
    any_level = has.copy()
    for k in range(1, LEVELS):
        any_level |= has[_level(np.arange(SLOTS), k)]
    ok, pk = has[word], any_level[prefix]
    d, s = _features(word[ok], doc[ok], prefix[pk], owner[pk])
    out = []
    for w, by_vote, bias in parts:
        dense = np.zeros(SLOTS)
        dense[slots] = w
        x = np.bincount(d, weights=dense[s], minlength=n) + bias
        for k in range(len(HEURISTICS)):
            x = x + by_vote[k][votes // 3**k % 3]
        out.append(x)
    out[0][np.diff(at) == 0] = 30.0
    return np.array(out)


def _score(model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, ends = texts(b.column("text"))
            x = [scores(model.value, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]) for i, j in spans_of(ends)]
            x = 1 / (1 + np.exp(-np.clip(np.concatenate(x, axis=1) if x else np.zeros((2, 0)), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x.max(axis=0)), pa.array(x[1])], names=[*b.schema.names, "score", "toxic_score"])

    return run


def _drawn(most: int, of: int) -> Column:
    """Of ``of`` rows about ``most``, told by a hash of rid; all where there are no more."""
    return F.lit(True) if of <= most else F.pmod(F.xxhash64("rid"), F.lit(1 << 31)) < int(most / of * (1 << 31))


def _posterior(post: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for p, q in sorted(post.items()) for x in (p, float(q))])[F.col("pattern")] if post else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame):
    """The posterior of each pattern of votes, votes of all docs (written), and the scorer trained on them."""
    spark = docs.sparkSession
    small_batches(spark)
    votes = docs.select("rid", "doc_id", "text").mapInArrow(_votes, "rid long, doc_id long, votes int")
    gold = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    gold = gold.select("doc_id", F.when(F.col("q") < 0.5, BAD).when(F.col("q").isNotNull(), GOOD).otherwise(NONE).alias("gold"), F.when(F.col("t").isNotNull(), (F.col("t") > 0.5).cast("double")).alias("toxic"))
    votes = votes.join(gold, "doc_id", "left").withColumn("pattern", F.col("votes") + F.coalesce("gold", F.lit(NONE)) * GOLD)
    labelled = (F.col("pattern") >= GOLD) | F.col("toxic").isNotNull()
    votes = written(votes.select("rid", "votes", "pattern", "toxic", labelled.alias("labelled")), "votes")
    counted = votes.groupBy("pattern", "labelled").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[int, int] = {}
    for r in counted:
        counts[r["pattern"]] = counts.get(r["pattern"], 0) + r["n"]
    post, table_, prior = label_model(counts, len(HEURISTICS) + 1)
    known = sum(r["n"] for r in counted if r["labelled"])
    rows = votes.where(F.when(F.col("labelled"), _drawn(SAMPLE, known)).otherwise(_drawn(UNLABELLED, sum(counts.values()) - known)))
    rows = rows.select("rid", "votes", _posterior(post).alias("quality"), "toxic")
    # At most SAMPLE + UNLABELLED small rows, give or take the chance of the hash, go to the texts.
    rows = written(docs.select("rid", "text").join(F.broadcast(rows), "rid").select("rid", "votes", *TARGETS, F.coalesce("text", F.lit("")).alias("text")).repartition(8, "rid"), "training")
    seen = rows.select("text", *TARGETS).mapInArrow(_seen, "slot long, n0 double, y0 double, n1 double, y1 double").groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n0", "y0", "n1", "y1")])
    mean = rows.agg(*[F.avg(t).alias(t) for t in TARGETS]).first()
    tell = [beyond_chance(f"n{k}", f"y{k}", mean[t] or 0.0).alias(t) for k, t in enumerate(TARGETS)]
    chosen = seen.select("slot", *tell).where(" or ".join(TARGETS)).toPandas().sort_values("slot")
    slots = chosen["slot"].to_numpy()
    own = [chosen[t].to_numpy(bool) for t in TARGETS]  # a target uses the features that tell on it
    # One task holds the training rows, whose number is bounded, as numbers of weighed features; the driver gets weights.
    got = rows.mapInArrow(_weighed(spark.sparkContext.broadcast(slots)), "rid long, votes int, quality double, toxic double, found binary")
    got = got.repartition(1).sortWithinPartitions("rid").mapInArrow(_trained(own), "target int, weights array<double>, by_vote array<double>, bias double")
    parts = [(np.array(r["weights"]), np.array(r["by_vote"]).reshape(-1, 3), r["bias"]) for r in got.orderBy("target").collect()]
    return post, votes, (slots, parts)


def scored(rows: DataFrame, model) -> DataFrame:
    """rows (text and any others) with score, the chance of bad, and toxic_score. The model has a weight a chosen slot."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(sent), StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("toxic_score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of docs (rid unique, doc_id, text): rid, posterior of the label model, score (chance of bad) and kept."""
    post, votes, model = fit(docs, labels)
    out = scored(docs.select("rid", "doc_id", "text"), model).drop("text").join(votes.select("rid", "pattern"), "rid")
    return out.select("rid", "doc_id", _posterior(post).alias("posterior"), "score", "toxic_score", kept().alias("kept"))


def kept() -> Column:
    return F.col("score") < 0.5


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of the label model, scores and verdict of every document.

    Cases: null and blank texts are rejected; texts of any length are read whole; ties (equal texts) get equal scores;
    documents without a label, labels without a document and null labels are fine; further columns are ignored; empty
    tables give no rows or, without labels, a verdict by the heuristics alone.
    """
    docs, _ = keyed(table(spark, sf_dir, "documents"), "op3")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "posterior", "score", "toxic_score", "kept")
