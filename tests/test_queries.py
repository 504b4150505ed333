"""Every registered query of the analytics engine equals its SQL check."""

import os

import pytest

import __spark_entry__ as entry
from codeloom.plans import registry
from compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_a_check():
    assert set(registry.QUERIES) <= set(CHECKS)
    assert set(CHECKS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    assert difference(spark, db, name, entry.queries()[name], CHECKS[name], SF) == ""


@pytest.mark.parametrize("name", ["type_nodes", "api_nodes"])
def test_one_pass_writes_nothing_and_reads_what_it_needs(spark, tmp_path, name):
    from codeloom.functions import patterns
    from codeloom.plans.workspace import Workspace

    orders = [(k, k % 5) for k in range(1, 60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "prose")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    assert not Workspace.of(spark, str(tmp_path))._tables
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    other = {"type_nodes": patterns.JS_ROUTE, "api_nodes": patterns.JS_CLASS}[name]
    assert other not in plan
    rows = sorted(map(str, found.collect()))
    # nodes that are staged are read instead, with the same rows
    assert Workspace.of(spark, str(tmp_path)).nodes.count() and rows
    assert sorted(map(str, entry.queries()[name](spark, str(tmp_path)).collect())) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
