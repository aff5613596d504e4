"""The rest of the library works without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_without_corpus_operators(tmp_path):
    for name in ("vellum", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "vellum/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "vellum").rglob("*.py"):
        if "llm" not in path.parts:
            assert "vellum.llm" not in path.read_text()
