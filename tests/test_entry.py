"""The driver's contract, with and without the operators for training data."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_of_sql_are_names_of_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_entry_works_without_the_training_data_operators(tmp_path):
    for p in ("sieveworks", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "sieveworks" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_pages_have_verdicts(spark):
    import __spark_entry__ as e

    rows = e.queries()["web_render_verdict"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.verdict for r in rows} <= {"embedded data", "client-rendered", "thin", "server-rendered"}
