import pytest

import __spark_entry__ as entry
import oracle_check
from crawlmill.plans import catalogue

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle_check.views(ROOT)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, ROOT).toPandas()
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert oracle_check.rows_of(got) == oracle_check.rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert plan(catalogue.QUERIES["page_summary"](spark, ROOT)).count("ArrowEvalPython") == 1
    for name in ("plan_links", "queue_upsert", "p4_found", "domain_cap"):
        assert "CartesianProduct" not in plan(catalogue.QUERIES[name](spark, ROOT))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,indexed)]" in plan(catalogue.QUERIES["indexed_count"](spark, ROOT))
