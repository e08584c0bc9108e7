"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from rentlens.catalog import load
from tests.oracle_check import compare, engine

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"A5_scan_zip_csv", "G10_match_fuzzy", "G11_close_match", "G13_city_defaults_fuzzy"}


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.fixture(autouse=True)
def clear_cache(spark):
    yield
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(load().ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF)[0] == "ok"


@pytest.mark.parametrize("name", ["G10_match_fuzzy", "G11_close_match", "G13_city_defaults_fuzzy"])
def test_queries_without_sql_run(spark, name):
    assert load().QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["city", "n", "immo_median", "zensus", "delta", "Gemeindename"]
    assert 0 < df.count() <= 20
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


MODEL_FREE = [n for n in sorted(load().ORACLES) if not n.startswith(("L", "A", "F6"))]


@pytest.mark.parametrize("name", MODEL_FREE[::6])
def test_plans_have_no_python_and_no_product(spark, name):
    plan = load().QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    if name not in PYTHON_ALLOWED:
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
