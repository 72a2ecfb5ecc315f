"""The entry module works with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", "tests", ".git", "__pycache__", "*.md", "*.json", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_nothing_else_imports_the_optional_subpackage():
    for file in (ROOT / "strandframe").rglob("*.py"):
        if "llm" not in file.parts:
            assert "strandframe.llm" not in file.read_text(), file
