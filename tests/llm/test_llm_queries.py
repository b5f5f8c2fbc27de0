"""Registered queries: one a operator, SQL where there is some, and a free import of the rest."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from marketloom.llm.queries import ORACLES, QUERIES
from marketloom.plans.tables import BASE
from tools.check import rows_of

from conftest import SF

ROOT = Path(__file__).resolve().parents[2]


def test_thirteen_operators_and_the_pipeline():
    import __spark_entry__ as entry

    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    engine = duckdb.connect()
    for table in BASE:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), engine.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.to_dict("records"), got.columns) == rows_of(want.to_dict("records"), want.columns)


@pytest.mark.parametrize("name", ["op1_licenses", "op6_sharding", "op10_url_lists"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_nothing_else_imports_this_folder():
    for path in [*(ROOT / "marketloom").rglob("*.py")]:
        if "llm" not in path.relative_to(ROOT / "marketloom").parts:
            assert "llm" not in re.sub(r"[A-Za-z]llm|llm[a-z]", "", path.read_text()), path


def test_entry_points_stand_without_the_folder(tmp_path):
    """A copy of the library without this folder and the pipeline still imports."""
    for path in [ROOT / "__spark_entry__.py", *(ROOT / "marketloom").rglob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(path.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
