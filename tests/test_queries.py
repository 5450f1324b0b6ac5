"""Every registered query beside its SQL twin, and a look at every plan."""

import pytest

from compare import differences, duck
from millrace.suite import everything

SUITE = everything()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(SUITE.queries))
def test_query(spark, con, sf, name):
    df = SUITE.queries[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SUITE.oracles:
        assert not differences(df, con, SUITE.oracles[name])
    else:
        df.collect()


def scans(spark, sf, name):
    plan = SUITE.queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line], plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    lines, _ = scans(spark, sf, "prepare_join_group")
    orders = next(line for line in lines if "o_orderstatus" in line)
    assert "EqualTo(o_orderstatus,F)" in orders and "o_orderdate" not in orders
    lines, _ = scans(spark, sf, "retention_kept")
    assert all("PushedFilters: [IsNotNull(ts)" in line for line in lines if "event_type" not in line)


def test_shuffles_are_as_few_as_they_should_be(spark, sf):
    count = lambda name: len([x for x in scans(spark, sf, name)[1].splitlines() if "Exchange hash" in x])
    assert count("split_match") == count("sample_fraction") == count("prompt_render") == count("guard_residency") == count("ledger_cost") == 0
    assert count("budget_usage") == count("trace_rollup") == count("latest_per_key") == count("dedupe_subset") == 1


def test_pages_and_search_are_top_k(spark, sf):
    for name in ("page_after_key", "search_documents", "event_page", "sql_order_limit"):
        assert "TakeOrderedAndProject" in scans(spark, sf, name)[1]
