"""Registered queries against their SQL, and that the rest works without this subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import same

from graphloom.llm.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_rest_works_without_llm(tmp_path, left):
    """Also where the pipeline is left behind, whose operators are gone: the entry doesn't offer it."""
    shutil.copytree(ROOT / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100; assert not [n for n in q if n.startswith('op') or n == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_entry_offers_all():
    import __spark_entry__

    assert {"pipeline", *QUERIES} <= set(__spark_entry__.queries())
