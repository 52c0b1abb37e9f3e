"""The registered queries with and without the subpackage for training data."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent
PROBE = """
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert names == set(e.order_queries()), names
assert sql == names, sql ^ names
print(len(names))
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_part(tmp_path, pipeline):
    ignored = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json")
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=ignored)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    # What is left of a deleted package when only its modules go.
    (copy / "trolley" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run(
        [sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 55
