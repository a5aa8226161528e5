"""The library works without the training-data operators, and never imports them."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_operators(tmp_path):
    shutil.copytree(ROOT / "graticule", tmp_path / "graticule", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    count, *rest = out.stdout.split()[-4:]
    assert int(count) > 150 and rest == ["False", "False", "True"], out.stderr


def test_nothing_else_imports_them():
    for file in (ROOT / "graticule").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", file.read_text(), re.M), file
