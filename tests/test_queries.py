"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest
from compare import differences, duckdb_tables

from __spark_entry__ import entry
from skylag.plans.oracle import ORACLE
from skylag.plans.queries import QUERIES



def queries():
    return QUERIES


def oracle_sql():
    return ORACLE


SF_DIR = "/root/testdata/sf0.001"
NO_SQL = {"model_forecast", "feature_importance", "attribution", "attribution_top", "feature_descriptions"}


@pytest.fixture(scope="module")
def connection():
    return duckdb_tables(SF_DIR)


def test_every_query_has_sql_unless_it_scores_models():
    assert set(queries()) - set(oracle_sql()) == NO_SQL
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    assert differences(queries()[name](spark, SF_DIR), connection, oracle_sql()[name]) == []


def test_entry(spark):
    frame = entry(spark)
    assert frame.count() > 0 and "delay_ratio" in frame.columns


@pytest.mark.parametrize("name", sorted(set(queries()) - NO_SQL))
def test_plan_stays_in_the_jvm_without_cross_joins(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_date_selection_filters_before_the_shuffle(spark):
    """The derived date is tested on line items below the first exchange."""
    plan = queries()["filter_date"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "lineitem.parquet" in line)
    above = next(i for i in range(scan, -1, -1) if "Exchange" in lines[i])
    assert any("Filter" in line and "year(" in line for line in lines[above:scan])


def test_summary_aggregates_before_joining_names(spark):
    plan = queries()["route_summary"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("HashAggregate")
