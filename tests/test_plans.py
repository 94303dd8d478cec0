"""Physical-plan guards over every registered query (planned on sf0.001)."""

import re

import __spark_entry__ as E
from meridian.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"

# Nested-loop joins are allowed only where the build side is provably bounded:
# month x plan-catalogue grids, the theta join against the threshold
# configuration, one-row snapshot rows whose constant date Catalyst folds into
# the join condition, and the scorecard's one-row attaches.
BOUNDED_NESTED_LOOP = {
    "fin_plan_month_matrix", "jn_cross_grid", "spn_plan_grid", "jn_theta_threshold",
    "term_exec_daily", "term_gtm_daily", "term_scorecard", "dq_single_row",
}


def test_no_cartesian_and_bounded_nested_loops(spark):
    offenders = {}
    queries = E.queries()
    for name in QUERIES:
        plan = queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan:
            offenders[name] = "CartesianProduct"
        elif "BroadcastNestedLoopJoin" in plan and name not in BOUNDED_NESTED_LOOP:
            offenders[name] = "BroadcastNestedLoopJoin"
    assert not offenders, offenders


def test_trailing_filters_reach_the_scan(spark):
    for name in ("gtm_active_organizations", "gtm_trial_risk", "flt_trailing_window"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate" in plan, name


def test_narrow_read_schema(spark):
    plan = E.queries()["eng_daily"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lineitem_scans = [l for l in plan.split("\n") if "FileScan parquet" in l and "lineitem.parquet" in l]
    assert lineitem_scans and all("l_extendedprice" not in l for l in lineitem_scans)


def test_filled_spines_never_travel(spark):
    """Dense rows are generated behind the last exchange; what is stacked before it is hashed, not sorted."""
    for name in ("core_metric_spine", "term_business_snapshot"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        fill = next(i for i, line in enumerate(lines) if "Generate explode(sequence(" in line and "__p" in line)
        assert not any("Exchange" in line for line in lines[:fill]), name
        assert not any("SortAggregate(key=[organization_id" in line and ("month_start" in line or "metric_date" in line) for line in lines), name


def test_accounts_are_planned_once_for_unit_economics(spark):
    plan = E.queries()["gtm_unit_economics"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 25


def test_figures_are_computed_before_periods_are_generated(spark):
    """A generated row only picks values; rounding and ratios are done once for a row with facts."""
    for name in ("core_metric_spine", "term_business_snapshot"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        above, _, below = plan.partition("Generate explode(sequence(")
        assert "round(" in below and "round(" not in above, name


def test_partitions_of_a_shuffle_are_not_a_fixed_number(spark):
    from meridian.session import INITIAL_PARTITIONS, PARTITION_BYTES, configure

    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "8")
    configure(other)
    plan = other.range(100).selectExpr("id % 7 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and f", {INITIAL_PARTITIONS})" in plan
    assert other.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(PARTITION_BYTES)
    other.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
    configure(other)
    assert other.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "32m"  # the submitter's


def test_calendar_join_computes_every_frame_once(spark):
    from meridian.plans.terminal import _calendar_join

    a = spark.createDataFrame([(1, 10, 0.5), (2, None, 1.5), (None, 30, 2.5)], "d long, x long, y double")
    b = spark.createDataFrame([(2, "u"), (3, None)], "e long, z string")
    rows = {tuple(r) for r in _calendar_join([(a, "d"), (b, "e")], "k").collect()}
    assert rows == {(1, 10, 0.5, None), (2, None, 1.5, "u"), (3, None, None, None), (None, None, None, None)}
    plan = E.queries()["term_finance_monthly"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence(0, __n#") == 1  # the budget grid


def test_snapshot_sums_all_movements_in_one_exchange(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when no side is small
    plan = E.queries()["term_business_snapshot"](other, SF)._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"#\d+L?", "", plan)
    by_month = re.findall(r"Exchange hashpartitioning\(organization_id, (?:_groupingexpression|month\w*|\w+_month),", plan)
    assert len(by_month) == 2  # the sessions and all else
    assert plan.count("Exchange hashpartitioning(account_id,") == 2  # leads and accounts, not the lines
    lines = [x.strip(" :+-*()0123456789") for x in plan.split("\n")]
    read = [tuple(lines[i + 1:i + 4]) for i, x in enumerate(lines) if "Exchange hashpartitioning(l_orderkey," in x]
    assert len(read) == 3 and len(set(read)) == 2  # deals and card spends read the same exchange


def test_a_scan_task_is_bounded(spark):
    from meridian.session import SCAN_BYTES, configure

    other = spark.newSession()
    configure(other)
    assert other.conf.get("spark.sql.files.maxPartitionBytes") == str(SCAN_BYTES)
    other.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    configure(other)
    assert other.conf.get("spark.sql.files.maxPartitionBytes") == "16m"  # the submitter's
