from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from conftest import SMALL

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 12


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
