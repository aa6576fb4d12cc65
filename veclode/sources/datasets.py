"""Named data sets: a folder with Parquet tables base (vec_id, embedding), queries (q_id, embedding) and truth
(q_id, rank, vec_id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn

#: Metric of each set, and whether its rows are brought to unit length.
SETS = {
    "sift-128-euclidean": ("L2", False),
    "fashion-mnist-784-euclidean": ("L2", False),
    "nytimes-256-angular": ("IP", True),
    "glove-100-angular": ("IP", False),
    "glove-25-angular": ("IP", True),
    "lastfm-64-dot": ("IP", True),
    "gist-960-euclidean": ("L2", False),
    "cohere-768-angular": ("IP", True),
    "llama-128-ip": ("IP", False),
    "yi-128-ip": ("IP", False),
    "agnews-mxbai-1024-euclidean": ("L2", False),
}


@dataclass
class Dataset:
    spark: SparkSession
    path: str
    metric: str = "L2"
    normalize: bool = False

    def _vectors(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df.withColumn("embedding", V.normalize(V.doubles(F.col("embedding")))) if self.normalize else df

    def get_database(self) -> DataFrame:
        return self._vectors("base")

    def get_queries(self) -> DataFrame:
        return self._vectors("queries")

    def get_groundtruth(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/truth").where(F.col("rank") <= k)

    def evaluate(self, found: DataFrame, k: int) -> DataFrame:
        return knn.recall(found, self.get_groundtruth(k), k)


def dataset(spark: SparkSession, name: str, data_dir: str = "datasets") -> Dataset:
    if name not in SETS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(SETS)}")
    return Dataset(spark, f"{data_dir}/{name}", *SETS[name])


def validated(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """df, or an error if a key is null or repeated, or vectors are null, of unequal length or not finite."""
    bad = df.select(
        F.sum(F.col(key).isNull().cast("long")).alias("no_key"), (F.count(key) - F.countDistinct(key)).alias("repeated"), F.sum(F.col("embedding").isNull().cast("long")).alias("no_vector"),
        (F.max(F.size("embedding")) - F.min(F.size("embedding"))).alias("unequal"),
        F.sum(F.exists(F.col("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("long")).alias("not_finite"),
    ).first().asDict()
    wrong = {k: v for k, v in bad.items() if v}
    if wrong:
        raise ValueError(f"vectors can't be used: {wrong}")
    return df
