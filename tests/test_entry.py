"""The driver's contract: names, oracles, and that the engine does without the subpackage llm."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_have_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


def test_nothing_else_imports_llm():
    for f in (ROOT / "turnwise").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "turnwise.llm" not in f.read_text(), f


def test_imports_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "turnwise", tmp_path / "turnwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 140 and out[1] == "False"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
