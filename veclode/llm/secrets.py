"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger, a Parquet table in a shared folder,
holds for each (blob, rule version) that was ever scanned the spans found. A scan looks only at blobs that the ledger
lacks under the current rule version, each once however many paths hold it, appends what it found, and joins the
findings back to all paths by blob.

Scans may run at the same time and append what they found twice; readers take one row of each blob, and
:func:`compacted` writes a ledger anew without repeats.

Cases: a null text is an empty one (an empty blob without findings); a text of any length is one blob, read whole;
repeated rows and equal texts share a blob and each get its spans; spans of different kinds may overlap, at one place
they come in the order of the rules; further columns are kept; an empty table gives no rows. Places are code points,
ends exclusive.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, scratch_dir, small_batches, table, texts, written

#: Fixed patterns of the rule set, in the order in which spans of one place are listed, with the least length that
#: counts: of group 2 (assign) or of the whole match.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]+", 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1),
}
VERSION = "rules-1"
BASE = ("assign", "access", "hex")
_RE = {k: re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)) for k, (p, _) in RULES.items()} | {"hex": re.compile("[0-9a-f]{24,}")}
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def spans(text: str, hexed: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed. hexed: False if the text is known to hold no hex run."""
    low, out = text.lower(), []
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in _RE["assign"].finditer(text) if m.end(2) - m.start(2) >= RULES["assign"][1]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _RE["access"].finditer(text) if m.end() - m.start() >= RULES["access"][1]]
    if hexed:  # runs are maximal, so one pattern with the least length finds the same as a filter afterwards
        out += [(m.start(), m.end(), "hex") for m in _RE["hex"].finditer(text)]
    if "PRIVATE KEY" in text:
        out += [(m.start(), m.end(), "pem") for m in _RE["pem"].finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in _RE["jwt"].finditer(text)]
    at = {k: i for i, k in enumerate(RULES)}
    return sorted(out, key=lambda x: (x[0], at[x[2]]))


def _hexed(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text, whether 24 hexadecimal bytes stand in a row anywhere near it."""
    f = _HEX[raw]
    for k in (1, 2, 4, 8):
        f = f[:-k] & f[k:] if len(f) > k else f[:0]
    f = f[:-8] & f[8:] if len(f) > 8 else f[:0]
    at = np.flatnonzero(f)
    return np.searchsorted(at, ends[1:]) > np.searchsorted(at, ends[:-1])


def _scan(batches):
    import pyarrow as pa

    for b in batches:
        col = b.column("text")
        hexed = _hexed(*texts(col))
        found = [",".join(f"{k}:{s}:{e}" for s, e, k in spans(t or "", h)) for t, h in zip(col.to_pylist(), hexed, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, pa.string())], names=["blob", "spans"])


SCHEMA = "blob binary, version string, spans string"


def known(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    """(blob, spans) of a rule version as the ledger is now, a row a blob however often it was appended.

    The option makes each read a relation of its own: Spark takes reads of one path for equal, whatever was appended
    between them, and in one plan would run but one of them.
    """
    rows = spark.read.option("snapshot", uuid.uuid4().hex).schema(SCHEMA).parquet(ledger).where(F.col("version") == version)
    return rows.groupBy("blob").agg(F.min("spans").alias("spans"))


def compacted(spark: SparkSession, ledger: str, to: str) -> None:
    """The ledger without repeated rows, in few files, at another place."""
    spark.read.schema(SCHEMA).parquet(ledger).groupBy("blob", "version").agg(F.min("spans").alias("spans")).write.parquet(to)


def scan(versions: DataFrame, ledger: str, version: str = VERSION) -> DataFrame:
    """versions (rid unique, text, any others but text kept) with blob and spans; ledger: folder of the ledger, made if missing."""
    spark = versions.sparkSession
    small_batches(spark)
    v = versions.withColumn("text", F.coalesce("text", F.lit("")))
    ids = written(v.withColumn("blob", F.unhex(F.sha2("text", 256))).drop("text"), "blobs")
    jvm = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    new = ids.groupBy("blob").agg(F.min("rid").alias("rid"))
    if there:
        new = new.join(known(spark, ledger, version).select("blob"), "blob", "left_anti")
    found = v.select("rid", "text").join(new, "rid").select("blob", "text").mapInArrow(_scan, "blob binary, spans string")
    found.select("blob", F.lit(version).alias("version"), "spans").write.mode("append").parquet(ledger)
    return ids.join(known(spark, ledger, version), "blob", "left")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base rules, and all spans.

    The documents come as a history of two loads, told apart by hash: the second load's scan finds in the ledger what the
    first has seen and reads only blobs that are new. Cases: null texts are empty, texts of any length are read whole, repeated
    rows and ties get their own row each, further columns are ignored, an empty table gives no rows.
    """
    docs, _ = keyed(table(spark, sf_dir, "documents"), "secrets")
    ledger, early = f"{scratch_dir(spark)}/veclode/ledger-{uuid.uuid4().hex}", F.xxhash64("rid") < 0
    out = scan(docs.where(early), ledger).unionByName(scan(docs.where(~early), ledger))
    every = F.when(F.col("spans") != "", F.split("spans", ",")).otherwise(F.array().cast("array<string>"))
    base = F.filter("_a", lambda x: F.split_part(x, F.lit(":"), F.lit(1)).isin(*BASE))
    out = out.withColumn("_a", every).withColumn("_b", base)
    n = lambda k: F.size(F.filter("_b", lambda x: x.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(n, BASE), F.sha2(F.array_join("_b", ","), 256).alias("base_sha256"), "spans")
