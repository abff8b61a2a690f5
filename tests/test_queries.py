"""Every registered query against its SQL on the smallest data, and the shape of its plan."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import GIVEN, compare
from workload import oracle, registry

DATA = "/root/testdata/sf0.001"
SQL = oracle.build()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"create view {name} as from '{DATA}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(registry.QUERIES)
    assert set(SQL) <= set(oracle_sql()) and set(registry.QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ("entities_plugged", "failing_texts", "landing_any_layout"):
        assert "Python" not in plan and "Pandas" not in plan
    assert compare(df, con, SQL[name]).startswith("ok")


def test_entry(spark):
    assert len(entry(spark).columns) == 13


def test_entry_without_the_text_operators(tmp_path):
    """They may be deleted; compiled files that stay behind make a package without modules."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "chatterscope", tmp_path / "chatterscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "workload", tmp_path / "workload")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "chatterscope" / "llm" / "__pycache__").mkdir(parents=True)
    asked = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-B", "-c", asked], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert said.stdout.split() == ["True", str(len(registry.QUERIES))]
        (tmp_path / "corpus_pipeline.py").write_text("from chatterscope.llm import exact\n")
