"""Physical-plan properties that the scale design relies on."""

import pytest

import __spark_entry__ as E
from cohortix.catalog import QUERIES

from .conftest import SF001


def _plan(spark, name):
    df = E.queries()[name](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products_anywhere(spark):
    bad = [n for n in QUERIES if "CartesianProduct" in _plan(spark, n)]
    assert bad == []


@pytest.mark.parametrize("name", ["m42_processor_churn", "m43_cohort_drivers", "m44_period_growth",
                                  "m50_occupancy"])
def test_range_and_spine_joins_are_equi_joins(spark, name):
    # the warehouse forms were cross / interval-overlap joins; here no
    # nested-loop join may remain
    assert "BroadcastNestedLoopJoin" not in _plan(spark, name)


def test_daily_snapshot_is_hash_aggregated_and_offsets_need_no_join(spark):
    p = _plan(spark, "m14_net_retention")
    assert "SortAggregate" not in p and "HashAggregate" in p
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p   # +12 lookup is a window
    # column pruning: only the used order columns are read
    scan = [line for line in p.split("\n") if "FileScan parquet" in line][0]
    assert "o_orderkey" not in scan and "o_custkey" in scan


def test_filters_reach_the_scan(spark):
    p = _plan(spark, "m11_arpu_by_line")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)" in p
