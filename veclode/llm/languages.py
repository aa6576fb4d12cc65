"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

* Text: lower case; every run of characters other than letters is one boundary, and n-grams of one to three characters
  are taken within and across single boundaries, over the whole text. They are counted in ``SLOTS`` hashed slots.
* Weights of terms: 1 + ln(count), times ln((1 + N) / (1 + documents with the slot)) + 1, scaled to unit length. N and the
  document counts are over all documents that may be learned from, one aggregation.
* Training: follow-the-regularised-leader (proximal, a learning rate for each weight) with an L1 and an L2 penalty, so most
  weights are exactly 0. It learns from about ``SAMPLE`` distinct texts, as many of each language at most, told by a hash of the
  text; this bound is the only thing that doesn't grow with the corpus. Every fifth of them is held back, and on these one temperature is
  chosen that makes the scores true chances (least log loss).
* Prediction reads the whole text and nothing else.

The bounded sample is trained on in one task, as terms; the driver gets the weights that aren't 0, of which there are at most
languages x ``SLOTS``.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing can be learned; equal
chances go to the language that is first by code point; texts of any length are read whole, a part at a time; equal
texts get equal results; documents without a language or text are not learned from; a null doc_id is hashed as the empty string;
further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches, table, written

#: Hashed slots, longest n-gram, texts learned from, characters taken at a time.
SLOTS, LONGEST, SAMPLE, PART = 1 << 15, 3, 4000, 1 << 20
#: FTRL: learning rate, its damping, L1 and L2 penalty, passes.
RATE, DAMP, LASSO, RIDGE, PASSES = 1.0, 1.0, 0.02, 0.002, 2
UNKNOWN = "und"
M = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _letters(text: str, known: dict[str, bool]) -> np.ndarray:
    """Code points of the text in lower case, runs of others than letters as one 0."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct = np.unique(x)
    for c in distinct.tolist():
        if c not in known:
            known[c] = chr(c).isalpha()
    x = np.where(np.array([known[c] for c in distinct.tolist()], bool)[np.searchsorted(distinct, x)], x, np.uint32(0)) if len(x) else x
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


def slots(text: str | None, known: dict[str, bool]) -> tuple[np.ndarray, np.ndarray] | None:
    """The slots of a text's n-grams and how often each occurs; None without a letter. known: what is a letter, so far."""
    count = np.zeros(SLOTS, np.int64)
    any_letter, tail = False, np.zeros(1, np.uint32)
    text = text or ""
    for s in range(0, len(text), PART):
        x = _letters(text[s : s + PART], known)
        any_letter |= bool(x.any())
        x = x[1:] if len(x) and tail[-1] == x[0] == 0 else x
        first, x = len(tail), np.concatenate((tail, x))  # the end of the part before, or a boundary
        if s + PART >= len(text) and len(x) and x[-1] != 0:
            x = np.append(x, np.uint32(0))
        h = np.zeros(len(x), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint32(n)) * M[n % 3]
            h ^= h >> np.uint32(15)
            # N-grams that end within the part before are counted already; a boundary alone is no n-gram.
            new = h[max(0, first - n + 1) :] if n > 1 else h[first:][x[first:] != 0]
            count += np.bincount((new * M[0]) >> np.uint32(32 - SLOTS.bit_length() + 1), minlength=SLOTS)
        tail = x[-(LONGEST - 1) :]
    if not any_letter:
        return None
    at = np.flatnonzero(count)
    return at, count[at]


def _documents(batches):
    """Of each task: in how many texts a slot occurs, and at slot -1 how many texts have a letter."""
    import pyarrow as pa

    known: dict[str, bool] = {}
    n, total = np.zeros(SLOTS, np.int64), 0
    for b in batches:
        for t in b.column("text"):
            if (found := slots(t.as_py(), known)) is not None:
                n[found[0]] += 1
                total += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], names=["slot", "n"])


def weighed(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(found[1])) * idf[found[0]]
    return x / np.sqrt((x * x).sum())


def _terms(sent):
    def run(batches):
        import pyarrow as pa

        known: dict[str, bool] = {}
        for b in batches:
            rows = []
            for key, lang, t in zip(b.column("key").to_pylist(), b.column("lang").to_pylist(), b.column("text"), strict=True):
                if (found := slots(t.as_py(), known)) is not None:
                    rows.append((key, lang, found[0].astype(np.int32), weighed(found, sent.value).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.float32()))], names=["key", "lang", "slot", "x"])

    return run


class Ftrl:
    """Follow-the-regularised-leader, proximal form, for a softmax over ``langs`` classes; the last slot is the intercept,
    which has no penalty."""

    def __init__(self, langs: int) -> None:
        self.z, self.n = np.zeros((SLOTS + 1, langs)), np.zeros((SLOTS + 1, langs))

    def weights(self, at: np.ndarray) -> np.ndarray:
        """Weights of slots: 0 where the gradients' sum is within the L1 penalty."""
        z, step = self.z[at], (DAMP + np.sqrt(self.n[at])) / RATE
        free = (at == SLOTS)[:, None]
        w = -(z - np.sign(z) * np.where(free, 0, LASSO)) / (step + np.where(free, 0, RIDGE))
        return np.where((np.abs(z) > LASSO) | free, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, SLOTS), np.append(x, 1.0)
        w = self.weights(at)
        g = softmax(x @ w)
        g[y] -= 1
        g = x[:, None] * g
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / RATE * w
        self.n[at] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(x: np.ndarray, y: np.ndarray) -> float:
    """The divisor of scores with the least log loss on rows x (of scores) with classes y, by golden section of its logarithm."""
    if not len(x):
        return 1.0

    def loss(t: float) -> float:
        s = x / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, cut = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _trained(langs: list[str]):
    def run(batches):
        import pyarrow as pa

        rows = []
        for b in batches:
            rows += [(int(k), langs.index(y), s.values.to_numpy(), x.values.to_numpy()) for k, y, s, x in zip(b.column("key").to_pylist(), b.column("lang").to_pylist(), b.column("slot"), b.column("x"), strict=True)]
        held = [r for r in rows if r[0] % 5 == 0]
        model = Ftrl(len(langs))
        for _ in range(PASSES):
            for _, y, at, x in rows:
                if _ % 5:
                    model.learn(at, x, y)
        w = model.weights(np.arange(SLOTS + 1))
        t = temperature(np.array([x @ w[at] + w[SLOTS] for _, _, at, x in held]).reshape(-1, len(langs)), np.array([r[1] for r in held], int))
        slot, lang = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slot, -1).astype(np.int32)), pa.array(np.append(lang, -1).astype(np.int32)), pa.array(np.append(w[slot, lang], t))], names=["slot", "lang", "w"])

    return run


class Model:
    """What prediction needs: languages, idf of slots, weights [slot][language] with the intercept last, temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, t: float) -> None:
        self.langs, self.idf, self.weights, self.t = langs, idf, weights, t

    def chances(self, text: str | None, known: dict[str, bool]) -> np.ndarray | None:
        found = slots(text, known) if self.langs else None
        if found is None:
            return None
        return softmax((weighed(found, self.idf) @ self.weights[found[0]] + self.weights[SLOTS]) / self.t)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (text, lang) of which those without a lang are left out; ``sample``: texts that are trained on at
    most, in equal parts by language, give or take the chance of a hash."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones(SLOTS), np.zeros((SLOTS + 1, 0)), 1.0)
    n = rows.select("text").mapInArrow(_documents, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(n["slot"].tolist(), n["n"].tolist(), strict=True))
    df = np.zeros(SLOTS)
    for slot, k in n.items():
        if slot >= 0:
            df[slot] = k
    idf = np.log((1 + n.get(-1, 0)) / (1 + df)) + 1
    # The key orders and draws rows by what they hold, so equal texts go together and any number of tasks gives the same model.
    share = F.create_map(*[x for c in langs for x in (F.lit(c), F.lit(min(1.0, sample / len(langs) / sizes[c])))])
    key = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 40))
    drawn = rows.withColumn("key", key).where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))
    # Equal texts count once: a hot text is one row before any text moves.
    drawn = drawn.groupBy("key", "lang").agg(F.first("text").alias("text"))
    terms = written(drawn.mapInArrow(_terms(spark.sparkContext.broadcast(idf)), "key long, lang string, slot array<int>, x array<float>"), "terms")
    got = terms.repartition(1).sortWithinPartitions("key", "lang").mapInArrow(_trained(langs), "slot int, lang int, w double").toPandas()
    weights = np.zeros((SLOTS + 1, len(langs)))
    real = got[got["slot"] >= 0]
    weights[real["slot"], real["lang"]] = real["w"]
    return Model(langs, idf, weights, float(got.loc[got["slot"] < 0, "w"].iloc[0]))


def _predicted(sent):
    def run(batches):
        import pyarrow as pa

        known: dict[str, bool] = {}
        for b in batches:
            lang, score = [], []
            for t in b.column("text"):
                p = sent.value.chances(t.as_py(), known)
                lang.append(UNKNOWN if p is None else sent.value.langs[int(p.argmax())])
                score.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any others) with lang_pred and score, the chance of that language."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predicted(sent), StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document's whole text, and its chance, learned from the documents that aren't held out.

    Cases: see the module.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where("not held_out"))
    return predicted(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
