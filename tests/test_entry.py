"""The entry module, with and without the text-preparation subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-1] == "False" and int(done.stdout.split()[-2]) > 50


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "quarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quarry.llm" not in path.read_text()
