"""Without the training-data operators the driver entry still imports, and no query of theirs is left."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {here!r})
import __spark_entry__ as entry
names = sorted(entry.queries())
assert names and set(entry.oracle_sql()) <= set(names), "SQL without a query"
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
print(len(names))
"""


def test_entry_without_the_subpackage(tmp_path):
    from tidemark.plans import catalog

    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(here=str(here))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) == len(catalog.QUERIES)


def test_queries_cover_their_sql():
    from tidemark.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
