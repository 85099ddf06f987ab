"""The contract module, with the text subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_the_text_subpackage(tmp_path):
    shutil.copytree(ROOT / "blockloom", tmp_path / "blockloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 40 and not any(n.startswith('op') for n in q); print('fine')"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.strip().endswith("fine"), said.stderr


def test_core_queries_stay_where_a_text_library_is_missing(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ImportError('no zstandard')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q); print('fine')"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True)
    assert said.stdout.strip().endswith("fine"), said.stderr


def test_nothing_else_imports_the_text_subpackage():
    for path in (ROOT / "blockloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "blockloom.llm" not in path.read_text()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).count() > 0
