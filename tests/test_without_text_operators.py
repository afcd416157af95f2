"""The rest of the repository works without the optional operators on text."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_optional_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    names = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"],
        cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert "build_features" in names and not [n for n in names if n.startswith("op") and n[2].isdigit()]
    assert "pipeline" not in names
