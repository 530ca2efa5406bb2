"""Every document query equals its SQL, and the entry works without the llm parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import CATALOGUE

from .oracle import connect, same

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CATALOGUE)
def test_query_equals_sql(spark, duck, name):
    query, sql = CATALOGUE[name]
    result = query(spark, SF)
    if sql:
        same(result, sql, duck)
    else:
        assert result.count() > 0


def test_entry_without_llm(tmp_path):
    for name in ("pagewright", "__spark_entry__.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op')])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(CATALOGUE)), str(sum(1 for _, s in CATALOGUE.values() if s)), "[]"]


def test_page_plan_has_no_shuffle(spark):
    plan = CATALOGUE["page_split"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
