"""The driver contract, with and without the part that may be absent."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_imports_without_the_optional_part(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not (copy / "stowage/llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_summary' in q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
