"""The driver's contract holds with and without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.oracle_sql()) - set(e.queries())))"


@pytest.mark.parametrize("gone", [[], ["tidebook/llm", "tests/llm"], ["tidebook/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_lists_queries_without_what_is_gone(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in map(copy.joinpath, gone):
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql, unknown = done.stdout.strip().split(" ", 2)
    assert int(queries) >= 50 and int(sql) >= 45 and unknown == "[]"
