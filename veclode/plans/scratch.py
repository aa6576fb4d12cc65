"""Tables that cut the lineage of loops, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a folder under the warehouse.

    On a cluster a warehouse on a local file system is no shared folder, so the setting must be there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and at.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at + "/_scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that is read back: a loop's next round starts from files, not from its whole history."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/veclode/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """df written as a table bucketed by key: later joins and groups on the key don't shuffle it again.

    The table is one of files in the scratch folder (or at path) and leaves the catalog at once, as what reads it knows
    its files and buckets.
    """
    spark = df.sparkSession
    at = f"veclode_{name}_{uuid.uuid4().hex}"
    out = df.write.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    out.option("path", path or f"{scratch_dir(spark)}/veclode/{at}").saveAsTable(at)
    table = spark.table(at)
    spark.sql(f"DROP TABLE {at}")
    return table


def reopened(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A table that :func:`bucketed` wrote, maybe in another session."""
    at = f"veclode_reopened_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {at} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    table = spark.table(at)
    spark.sql(f"DROP TABLE {at}")
    return table
