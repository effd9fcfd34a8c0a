"""The entry module without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(HERE / "siteaudit", tmp_path / "siteaudit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q) and not [n for n in q if n.startswith(('op', 'pipeline'))]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_imports_them():
    for path in (HERE / "siteaudit").rglob("*.py"):
        if "llm" not in path.relative_to(HERE).parts:
            assert "llm" not in path.read_text(), path
