"""The entry without the training-data part, whose folders and pipeline file may be gone or half gone."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("kerbline/llm",), ("kerbline/llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_optional_part(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "kerbline"), copy / "kerbline", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "kerbline/llm" in gone else [])))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
