"""The driver contract, also without the text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as driver

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["o_orderkey", "revenue", "o_orderdate"] and df.count() == 10


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_without_text_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_q3' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_imports_the_text_operators():
    for path in (ROOT / "brindle").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
