"""What stands alone and what is written where."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "huntframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "huntframe").parts:
            assert not re.search(r"^\s*(from|import) (huntframe\.llm|corpus_pipeline)", path.read_text(), re.M), path


def test_the_rest_works_without_them(tmp_path):
    for name in ("huntframe", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), q
assert set(e.oracle_sql()) <= set(q)
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert e.entry(spark).count() > 0
assert q['auth_success_after_failures'](spark, '/root/testdata/sf0.001').count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=300)


def test_no_local_checkpoints_and_no_driver_collects_of_tables():
    for path in (ROOT / "huntframe").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".toPandas()" not in text and "crossJoin(" not in text, path
