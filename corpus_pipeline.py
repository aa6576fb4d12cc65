"""The corpus pipeline: five stages over documents, each one operator; written and reread between stages.

Every stage takes (spark, docs, sf_dir) and all columns of documents, and all but the last return the same columns.
Extra columns of any name pass through unchanged, as rows travel as one struct. Rows that repeat another row or have no
doc_id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclode.llm import classifier, decontaminate, mixing, neardup, sharding
from veclode.llm.common import keyed, n_words, table, written

#: Jaccard similarity of 5-word shingles, in percent, from which the stage links documents; the query op8 has its own.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: low quality or toxic, null and blank texts too; equal texts alike.
    Texts of any length are read whole; without labels heuristics decide; an empty table stays empty."""
    rows, _ = keyed(docs, "quality", whole=True)
    _, _, model = classifier.fit(rows, table(spark, sf_dir, "labels"))
    return classifier.scored(rows.select("text", "row"), model).where(classifier.kept()).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links of at least 80 % the document with the smallest doc_id stays; texts without words are
    no duplicates."""
    rows, _ = keyed(docs, "near", whole=True)
    found = neardup.near_duplicates(rows.select("rid", "doc_id", "text"), percent=NEAR)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("one")).select("one.rid")
    return rows.select("rid", "row").join(first, "rid", "left_semi").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go; null and blank texts stay, repeated rows go alike, texts of any
    length are read whole. An empty table, or benchmark, changes nothing."""
    rows, _ = keyed(docs, "leaks", whole=True)
    found = decontaminate.overlaps(rows.select("rid", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("rid", "row").join(found.select("rid").distinct(), "rid", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix takes it, to the nearest whole time; not at all if under half (a tie is rounded up). Null and
    blank texts have no words and go; a null source is a source; an empty table stays empty."""
    rows, _ = keyed(docs, "mix", whole=True)
    slim = rows.select("rid", "doc_id", F.col("row.source").alias("source"), n_words(F.col("text")).alias("size"))
    taken = mixing.mix(slim).select("rid", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("times")).where("times > 0")
    return rows.select("rid", "row").join(taken, "rid").select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, slot and shard among one more; such columns of documents are replaced."""
    out = sharding.assign(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row")))
    new = ["shard", "slot", "grown_shard"]
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *new)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Training, similarity search and hashes of words have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
