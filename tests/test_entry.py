import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_names_can_be_read_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"q_id", "rank", "vec_id", "dist"}


def test_nothing_outside_imports_the_training_data_part():
    for p in (REPO / "veclode").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "llm" not in p.read_text(), p
