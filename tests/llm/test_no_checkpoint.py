"""Operators on embeddings and conversations in a session that sets no checkpoint folder."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def test_other_tables_need_no_checkpoint_folder(tmp_path):
    """op6, op11, op12 and op13, in a session of its own process that sets neither checkpoint nor shuffle settings."""
    code = """
import sys
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", "file://" + sys.argv[1] + "/wh").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
sf = sys.argv[1] + "/sf"
s.createDataFrame([(1, "a b c " * 50, "x", "en"), (2, "d e f " * 50, "y", "de")], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(sf + "/documents.parquet")
s.createDataFrame([(1, [0.5] * 64), (2, [-0.5] * 64)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(sf + "/embeddings.parquet")
s.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "user", "Bye.")], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(sf + "/conversations.parquet")
from veclode.llm import queries
found = {name.split("_")[0]: f for name, f in queries.queries().items()}
assert {k: found[k](s, sf).count() for k in ("op6", "op11", "op12", "op13")} == {"op6": 3, "op11": 2, "op12": 2, "op13": 2}
assert not s.catalog.listTables()
"""
    (tmp_path / "conf").mkdir()  # no defaults of this machine
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=REPO, check=True, timeout=600, env=os.environ | {"SPARK_CONF_DIR": f"{tmp_path}/conf"})
