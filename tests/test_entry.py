import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

RUN = """
import __spark_entry__ as e
from driftline.session import session
names = set(e.queries())
assert "voyages_long" in names and not any(n.startswith("op1_") for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
spark = session("entry", **{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
assert e.entry(spark).count() > 0
print("rows")
"""


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_the_rest_works_without_the_corpus_operators(tmp_path, pipeline_stays):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if not pipeline_stays:
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.endswith("rows\n"), done.stderr[-2000:]
