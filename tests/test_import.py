"""The entry points can be imported before there is a Spark session, with and without the llm folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder) -> list[str]:
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()


def test_import_without_a_session():
    assert "slice_metrics" in names(ROOT)


def test_import_without_llm(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)  # must not matter, with or without it
    shutil.copytree(ROOT / "gaugeworks", tmp_path / "gaugeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    found = names(tmp_path)
    assert "slice_metrics" in found and not [n for n in found if n.startswith("op") and n[2].isdigit()]
