"""Quality rules: a learned decision list.

Per document some counts are taken with built-in functions. Where labels say which documents are bad, sequential
covering grows a conjunction of thresholds on ratios of these counts by information gain on two thirds of the labelled
rows, prunes it on the other third, keeps it if it is precise there (``PRECISION`` of at least ``SUPPORT`` rows), drops
what it covers and starts again, until no rule is precise. A conjunction has at most ``MAX_TERMS`` terms and a list at
most ``MAX_RULES`` rules: parameters that keep it readable. Thresholds are values at quantiles of the labelled rows that don't
depend on the rows' order, so a rerun learns the same list. Each step is one aggregation over the labelled rows that returns counts by (feature, bin): a
table of fixed size. The list comes out as one ordered CASE expression. No Python runs on the executors.

Cases: a null or blank text has no words and fails the base rule; texts of any length are read whole; texts under five
words have no repeated windows; a document labelled more than once counts once, by its mean label; labels that are null
or of unknown documents teach nothing; without labels of both kinds the list is empty and only the base rule drops; of
terms with the same gain the first in the order of features and thresholds wins; repeated rows each get their own result;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import squeezed, table, written

#: Features on which rules may set thresholds, as expressions on the counts.
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbols_a_word": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "capitals": "n_upper / word_chars",
    "bangs_a_word": "n_bang / n_words",
    "digits": "n_digit / word_chars",
    "distinct_words": "n_distinct / n_words",
    "words": "cast(n_words as double)",
}
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99)
MAX_RULES, MAX_TERMS, PRECISION, SUPPORT = 8, 3, 0.9, 3


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    d = d.withColumn("_s", squeezed(F.col("_t")))
    d = d.withColumn("_w", F.when(F.col("_s") != "", F.split("_s", " ")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col("_w")
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_h", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window pay for finding the places: windows in the order of their hash, equal neighbours.
    d = d.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    o = F.col("_o")
    d = d.withColumn("_p", F.array_sort(F.transform(F.filter("_o", lambda x, j: (F.get(o, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(o, j - 1)["h"] == x["h"]))), lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("p")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])
    return d.select(
        "doc_id", "n_words",
        F.when(F.col("n_words") > 0, F.length("_s") - F.col("n_words") + 1).otherwise(0).cast("long").alias("word_chars"),
        _count(F.col("_t"), r"#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _count(F.col("_t"), "A-ZÀ-ÖØ-Þ").alias("n_upper"), _count(F.col("_t"), "!").alias("n_bang"), _count(F.col("_t"), "0-9").alias("n_digit"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


Term = tuple[str, str, float]  # feature, "<=" or ">", threshold


def _holds(rule: list[Term]) -> Column:
    out = F.lit(True)
    for f, op, x in rule:
        out = out & ((F.col(f) <= x) if op == "<=" else (F.col(f) > x))
    return out


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.coalesce(F.expr(f"try_divide({x.replace(' / ', ', ')})" if " / " in x else x), F.lit(0.0)) for k, x in FEATURES.items()})


def learn(stats: DataFrame, labels: DataFrame) -> list[list[Term]]:
    """The rules, in order, each a conjunction under which a document is bad; labels: (doc_id, quality), 0 is bad."""
    named = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"))
    rows = with_features(stats.where(~base_failed())).join(named, "doc_id").select("doc_id", "bad", *FEATURES)
    rows = written(rows.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3), "rules")
    cuts = _cuts(rows)
    if not any(cuts.values()):
        return []
    # bin b of a feature: the number of thresholds below its value
    bins = F.array(*[_below(F.col(f), cuts[f]) for f in FEATURES])
    grow, prune, names = rows.where("fold > 0").withColumn("_b", bins), rows.where("fold = 0"), list(FEATURES)
    rules: list[list[Term]] = []
    while len(rules) < MAX_RULES:
        seen = ~_any(rules)
        rule: list[Term] = []
        while len(rule) < MAX_TERMS:
            got = grow.where(seen & _holds(rule)).select("bad", F.posexplode("_b").alias("f", "b")).groupBy("f", "b").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect()
            best = _best(got, names, cuts)
            if best is None:
                break
            rule.append(best[0])
            if best[1] >= 0.99:
                break
        if not rule:
            break
        cut = prune.where(seen).agg(*[x for k in range(1, len(rule) + 1) for x in (F.sum(F.when(_holds(rule[:k]), F.col("bad"))).alias(f"p{k}"), F.sum(_holds(rule[:k]).cast("int")).alias(f"n{k}"))]).first()
        worth = [((2 * (cut[f"p{k}"] or 0) / cut[f"n{k}"] - 1) if cut[f"n{k}"] else -1.0, -k) for k in range(1, len(rule) + 1)]
        value, k = max(worth)
        rule = rule[:-k]
        if (value + 1) / 2 < PRECISION or (cut[f"n{-k}"] or 0) < SUPPORT:
            break
        rules.append(rule)
    return rules


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each feature: values of rows at the quantiles, up to half a per cent.

    Values are counted in bins of that width on a logarithmic scale (a few thousand a feature, whatever the rows are) and
    a bin stands for its largest value, so the order of rows tells nothing.
    """
    x = F.array(*FEATURES)
    e = rows.select(F.posexplode(x).alias("f", "x")).withColumn("b", F.round(F.log(F.greatest("x", F.lit(0.0)) + 1e-6) * 200).cast("int"))
    bins: dict[int, list] = {}
    for r in e.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x")).orderBy("f", "b").collect():
        bins.setdefault(r["f"], []).append(r)
    out: dict[str, list[float]] = {}
    for i, f in enumerate(FEATURES):
        total, upto, cuts = sum(r["n"] for r in bins.get(i, [])), 0, set()
        for r in bins.get(i, []):
            if any(upto < q * total <= upto + r["n"] for q in QUANTILES):
                cuts.add(r["x"])
            upto += r["n"]
        out[f] = sorted(cuts)
    return out


def _below(x: Column, cuts: list[float]) -> Column:
    """How many of the thresholds lie below x."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x))


def _any(rules: list[list[Term]]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _holds(r)
    return out


def _best(got: list, names: list[str], cuts: dict[str, list[float]]) -> tuple[Term, float] | None:
    """The term of the highest information gain from counts by (feature, bin), with its precision."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in got:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    best = None
    for f, counted in sorted(by.items()):
        p0, n0 = (sum(x[i] for x in counted.values()) for i in (0, 1))
        if not p0:
            return None
        for j, c in enumerate(cuts[names[f]]):
            low = [x for b, x in counted.items() if b <= j]  # value <= c: fewer than j + 1 thresholds lie below it
            pl, nl = (sum(x[i] for x in low) for i in (0, 1))
            for op, p, n in (("<=", pl, nl), (">", p0 - pl, n0 - nl)):
                if p >= SUPPORT and n < n0:
                    gain = p * (math.log2(p / n) - math.log2(p0 / n0))
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, (names[f], op, float(c)), p / n)
    return best and best[1:]


def verdict(rules: list[list[Term]]) -> Column:
    """Kept or not, as one ordered CASE expression: the base rule first, then the learned rules, else kept."""
    out = F.when(base_failed(), False)
    for r in rules:
        out = out.when(_holds(r), False)
    return out.otherwise(True)


def as_sql(rules: list[list[Term]]) -> str:
    """The list as text for people to read."""
    return "CASE " + " ".join("WHEN " + " AND ".join(f"{f} {op} {x!r}" for f, op, x in r) + " THEN false" for r in rules) + " ELSE true END" if rules else "true"


def apply_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[Term]]]:
    """Counts, base_failed and kept of every document, and the rules learned."""
    stats = written(counts(docs), "counts")
    rules = learn(stats, labels)
    return with_features(stats).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules)), rules


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rule and verdict of every document; cases as stated for the module: null and blank texts fail the
    base rule, texts of any length are read whole, ties and repeated rows get equal results, further columns (of labels
    too) are ignored, empty tables give no rows."""
    out, _ = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
