import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path / "r", capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""}).stdout
    assert "scene_candidates" in said and "op1_" not in said and "pipeline" not in said
