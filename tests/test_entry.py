"""The entry points, with and without the subpackage for training text."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["page_id", "title"] and got.count() == 50


def test_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "webloom", tmp_path / "webloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_title' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    # The portfolio builds Columns when its queries run, not when it is imported.
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "webloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "webloom.llm" not in path.read_text(), path
