import pytest

import __spark_entry__ as entry
from tessera import plans
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, db, name):
    got = plans.QUERIES[name](spark, FOLDER).toPandas()
    want = db.execute(plans.SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


def test_every_query_has_sql():
    assert set(plans.QUERIES) - set(plans.SQL) == {"communities"}


def test_findings_by_rules_come_first(spark):
    rows = plans.QUERIES["findings_in_order"](spark, FOLDER).collect()
    order = [(r.classifier != "rule", -r.confidence, r.log_id) for r in rows]
    assert order == sorted(order) and {r.classifier for r in rows} == {"rule", "fallback"}


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = plans.QUERIES["multi_filter_count"](spark, FOLDER)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PushedFilters: [" in scan and "o_orderstatus" in scan.split("PushedFilters")[1]
    assert "o_totalprice" not in scan.split("ReadSchema")[1]


def test_ends_that_are_no_routes_are_not_shuffled(spark):
    plan = plans.QUERIES["route_impact"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">= o:") >= 2 and plan.count("<= o:") >= 2
