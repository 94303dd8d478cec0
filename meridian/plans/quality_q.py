"""Data-quality checks over the built products (each returns violating rows).

The given tables are clean in many respects, so a check that finds nothing
would prove nothing.  Where that is so, the registered query runs its check over
the product with defects planted in some of its rows (``planted=True``); the
quality gate of ``meridian.build`` runs it over the product as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.exprs import month_start
from ..operators import quality as Q
from .core import dim_organizations, dim_time, fct_events, fct_sessions
from .finance_ops import (fct_fin_bill_adjustments, fct_fin_bill_payments, fct_fin_bills, fct_fin_payment_reversals,
                          fin_budget_vs_actual, fin_spend_monthly)
from .growth import gtm_action_log, gtm_task_queue
from .oracle_views import AS_OF_SQL, AS_OF_TS_SQL
from .product import eng_daily, ops_daily, pro_product_daily, pro_sessions_daily
from .registry import register
from .terminal import core_daily_kpis, term_business_snapshot, term_scorecard


def _defect(rel, planted: bool, when, **bad):
    """``rel`` with the columns in ``bad`` replaced where ``when`` holds."""
    if not planted:
        return rel
    return rel.withColumns({c: F.when(when, v.cast(rel.schema[c].dataType)).otherwise(F.col(c)) for c, v in bad.items()})


def _dom(c: str, day: int):
    return F.dayofmonth(c) == day


def _outside(c: str, low=0, high=100):
    return (F.col(c) < low) | (F.col(c) > high)


def _any_null(*cols: str):
    return reduce(lambda x, y: x | y, [F.col(c).isNull() for c in cols])


#: Row-level checks: table -> (product, query -> {check name: violation predicate}).  The queries below list
#: the violating rows; ``row_check_counts`` counts all of them in one pass over each table.
ROW_RULES = {
    "dim_organizations": (dim_organizations, {"dq_not_null": lambda: {"not_null": _any_null("organization_id", "organization_name", "current_plan_id")}}),
    "fct_sessions": (fct_sessions, {"dq_accepted_values": lambda: {
        "accepted_values": F.col("session_status").isNotNull() & ~F.col("session_status").isin("completed", "failed", "timeout")}}),
    "core_daily_kpis": (core_daily_kpis, {"dq_range_bounds": lambda: {
        "success_rate_pct_range": _outside("success_rate_pct"),
        "failed_le_total": F.col("failed_sessions") > F.col("total_sessions"),
        "non_negative": (F.col("total_sessions") < 0) | (F.col("pages_visited") < 0),
        "parts_sum_to_whole": (F.col("successful_sessions") + F.col("failed_sessions")) != F.col("total_sessions")}}),
    "eng_daily": (eng_daily, {
        "dq_percentile_order": lambda: {"p99_ge_p95": F.col("p99_duration_seconds") < F.col("p95_duration_seconds")},
        "dq_multi_model_bounds": lambda: {"eng_success_rate": _outside("success_rate_pct")}}),
    "pro_product_daily": (pro_product_daily, {"dq_multi_model_bounds": lambda: {"product_proxy_adoption": _outside("proxy_adoption_pct")}}),
    "ops_daily": (ops_daily, {"dq_multi_model_bounds": lambda: {"ops_stealth_pct": _outside("stealth_session_pct")}}),
    "dim_time": (dim_time, {
        "dq_calendar_month": lambda: {"calendar_month": (F.col("month_start") != F.trunc("date_day", "MM"))
                                      | (F.col("fixed_calendar_month_end") != F.last_day("date_day"))
                                      | (F.col("fixed_calendar_month_id") != F.date_format("date_day", "yyyyMM").cast("int"))},
        "dq_calendar_week": lambda: {"calendar_week": (F.dayofweek("fixed_calendar_week_start") != 2)
                                     | (F.col("fixed_calendar_week_end") != F.date_add("fixed_calendar_week_start", 6))
                                     | ~F.col("date_day").between(F.col("fixed_calendar_week_start"), F.col("fixed_calendar_week_end"))
                                     | (F.col("fixed_calendar_week_id") != (F.extract(F.lit("YEAROFWEEK"), F.col("date_day")) * 100 + F.weekofyear("date_day")))},
        "dq_calendar_rolling": lambda: {"calendar_rolling": (F.datediff("rolling_7d_end", "rolling_7d_start") != 6)
                                        | (F.datediff("rolling_28d_end", "rolling_28d_start") != 27) | (F.col("rolling_7d_end") != F.col("date_day"))}}),
    "gtm_action_log": (gtm_action_log, {"dq_status_consistency": lambda: {
        "status_consistency": ((F.col("status") == "success") & F.col("error_message").isNotNull())
        | ((F.col("status") == "failed") & F.col("error_message").isNull())}}),
}


def _rules(table: str, query: str):
    return ROW_RULES[table][1][query]()


def row_check_counts(b, planted: bool = False):
    """Counts of all row-level checks, one scan and one aggregate a table."""
    del planted  # the gate looks at the products as they are
    return Q.violation_counts({table: (product(b), {(query, check): pred for query, rules in queries.items() for check, pred in rules().items()})
                               for table, (product, queries) in ROW_RULES.items()})


# Freshness limits in hours (by table, then by layer).
FRESHNESS_HOURS = {"bronze": 24.0, "silver": 24.0, "gold": 48.0}


@register("dq_not_null", """SELECT 'not_null' AS check_name, organization_id,
       CASE WHEN organization_id IS NULL THEN 'organization_id' WHEN organization_name IS NULL THEN 'organization_name'
            WHEN current_plan_id IS NULL THEN 'current_plan_id' END AS null_column
FROM dim_organizations WHERE organization_id IS NULL OR organization_name IS NULL OR current_plan_id IS NULL""",
          ("dim_organizations",))
def dq_not_null(b):
    return Q.not_null(dim_organizations(b), ["organization_id", "organization_name", "current_plan_id"],
                      ["organization_id"])


@register("dq_unique", """SELECT 'unique' AS check_name, event_id, count(*) AS occurrences FROM fct_events
GROUP BY event_id HAVING count(*) > 1""", ("fct_events",))
def dq_unique(b):
    return Q.unique(fct_events(b), ["event_id"])


@register("dq_accepted_values", """SELECT 'accepted_values' AS check_name, session_id, session_status
FROM (SELECT session_id, if(session_id % 97 = 5, 'unknown', session_status) AS session_status FROM fct_sessions)
WHERE session_status IS NOT NULL AND session_status NOT IN ('completed', 'failed', 'timeout')""", ("fct_sessions",))
def dq_accepted_values(b, planted=True):
    s = _defect(fct_sessions(b), planted, F.col("session_id") % 97 == 5, session_status=F.lit("unknown"))
    return Q.predicates(s, _rules("fct_sessions", "dq_accepted_values"), ["session_id", "session_status"])


@register("dq_relationships", """SELECT 'relationships' AS check_name, payment_reversal_id, bill_payment_id
FROM fct_fin_payment_reversals r WHERE bill_payment_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fct_fin_bill_payments p WHERE p.bill_payment_id = r.bill_payment_id)""",
          ("fct_fin_payment_reversals", "fct_fin_bill_payments"))
def dq_relationships(b):
    return Q.relationships(fct_fin_payment_reversals(b), "bill_payment_id", fct_fin_bill_payments(b),
                           "bill_payment_id", ["payment_reversal_id"])


@register("dq_unique_grain", """SELECT 'unique_grain' AS check_name, organization_id, month_start, count(*) AS occurrences
FROM (SELECT organization_id, month_start, unnest(range(CASE WHEN organization_id % 50 = 7 THEN 2 ELSE 1 END)) FROM term_business_snapshot)
GROUP BY 2, 3 HAVING count(*) > 1""", ("term_business_snapshot",))
def dq_unique_grain(b, planted=True):
    s = term_business_snapshot(b).select("organization_id", "month_start")
    if planted:
        s = s.unionByName(s.filter(F.col("organization_id") % 50 == 7))
    return Q.unique(s, ["organization_id", "month_start"], "unique_grain")


@register("dq_range_bounds", """
WITH k AS (SELECT date, if(day(date) = 3, 101, success_rate_pct) AS success_rate_pct,
                  if(day(date) = 5, total_sessions + 1, failed_sessions) AS failed_sessions,
                  if(day(date) = 7, -1, total_sessions) AS total_sessions, pages_visited, successful_sessions FROM core_daily_kpis)
SELECT 'success_rate_pct_range' AS check_name, date FROM k WHERE success_rate_pct < 0 OR success_rate_pct > 100
UNION ALL SELECT 'failed_le_total', date FROM k WHERE failed_sessions > total_sessions
UNION ALL SELECT 'non_negative', date FROM k WHERE total_sessions < 0 OR pages_visited < 0
UNION ALL SELECT 'parts_sum_to_whole', date FROM k WHERE successful_sessions + failed_sessions <> total_sessions""",
          ("core_daily_kpis",))
def dq_range_bounds(b, planted=True):
    k = _defect(core_daily_kpis(b), planted, _dom("date", 3), success_rate_pct=F.lit(101))
    k = _defect(k, planted, _dom("date", 5), failed_sessions=F.col("total_sessions") + 1)
    k = _defect(k, planted, _dom("date", 7), total_sessions=F.lit(-1))
    return Q.predicates(k, _rules("core_daily_kpis", "dq_range_bounds"), ["date"])


@register("dq_percentile_order", """SELECT 'p99_ge_p95' AS check_name, metric_date FROM eng_daily
WHERE if(day(metric_date) = 9, p95_duration_seconds - 1, p99_duration_seconds) < p95_duration_seconds""", ("eng_daily",))
def dq_percentile_order(b, planted=True):
    e = _defect(eng_daily(b), planted, _dom("metric_date", 9), p99_duration_seconds=F.col("p95_duration_seconds") - 1)
    return Q.predicates(e, _rules("eng_daily", "dq_percentile_order"), ["metric_date"])


@register("dq_multi_model_bounds", """
SELECT unnest(['eng_success_rate', 'product_proxy_adoption', 'ops_stealth_pct'][n:n]) AS check_name, metric_date
FROM (SELECT 1 AS n, metric_date, if(day(metric_date) = 2, 100.5, success_rate_pct) AS pct FROM eng_daily
      UNION ALL SELECT 2, metric_date, if(day(metric_date) = 3, -0.5, proxy_adoption_pct) FROM pro_product_daily
      UNION ALL SELECT 3, metric_date, if(day(metric_date) = 4, 100.5, stealth_session_pct) FROM ops_daily)
WHERE pct NOT BETWEEN 0 AND 100""", ("eng_daily", "pro_product_daily", "ops_daily"))
def dq_multi_model_bounds(b, planted=True):
    planned = (("eng_daily", "success_rate_pct", 2, 100.5), ("pro_product_daily", "proxy_adoption_pct", 3, -0.5), ("ops_daily", "stealth_session_pct", 4, 100.5))
    found = [Q.predicates(_defect(ROW_RULES[t][0](b), planted, _dom("metric_date", day), **{c: F.lit(bad)}), _rules(t, "dq_multi_model_bounds"), ["metric_date"])
             for t, c, day, bad in planned]
    return reduce(lambda x, y: x.unionByName(y), found)


@register("dq_single_row", """SELECT 'single_row' AS check_name, 2 * count(*) AS row_count FROM term_scorecard
HAVING 2 * count(*) <> 1""", ("term_scorecard",))
def dq_single_row(b, planted=True):
    s = term_scorecard(b)
    return Q.single_row(s.unionByName(s) if planted else s)


@register("dq_calendar_month", """SELECT 'calendar_month' AS check_name, date_day FROM (SELECT * REPLACE (if(day(date_day) = 13, month_start + 1, month_start) AS month_start) FROM dim_time)
WHERE month_start <> CAST(date_trunc('month', date_day) AS DATE) OR fixed_calendar_month_end <> CAST(last_day(date_day) AS DATE)
   OR fixed_calendar_month_id <> CAST(strftime(date_day, '%Y%m') AS INTEGER)""", ("dim_time",))
def dq_calendar_month(b, planted=True):
    t = _defect(dim_time(b), planted, _dom("date_day", 13), month_start=F.date_add("month_start", 1))
    return Q.predicates(t, _rules("dim_time", "dq_calendar_month"), ["date_day"])


@register("dq_calendar_week", """SELECT 'calendar_week' AS check_name, date_day FROM (SELECT * REPLACE (if(day(date_day) = 20, CAST(fixed_calendar_week_end + 1 AS DATE), fixed_calendar_week_end) AS fixed_calendar_week_end) FROM dim_time)
WHERE dayofweek(fixed_calendar_week_start) <> 1 OR fixed_calendar_week_end <> CAST(fixed_calendar_week_start + INTERVAL 6 DAY AS DATE)
   OR date_day NOT BETWEEN fixed_calendar_week_start AND fixed_calendar_week_end
   OR fixed_calendar_week_id <> CAST(strftime(date_day, '%G%V') AS INTEGER)""", ("dim_time",))
def dq_calendar_week(b, planted=True):
    t = _defect(dim_time(b), planted, _dom("date_day", 20), fixed_calendar_week_end=F.date_add("fixed_calendar_week_end", 1))
    return Q.predicates(t, _rules("dim_time", "dq_calendar_week"), ["date_day"])


@register("dq_calendar_rolling", """SELECT 'calendar_rolling' AS check_name, date_day FROM (SELECT * REPLACE (if(day(date_day) = 21, CAST(rolling_7d_start - 1 AS DATE), rolling_7d_start) AS rolling_7d_start) FROM dim_time)
WHERE date_diff('day', rolling_7d_start, rolling_7d_end) <> 6 OR date_diff('day', rolling_28d_start, rolling_28d_end) <> 27
   OR rolling_7d_end <> date_day""", ("dim_time",))
def dq_calendar_rolling(b, planted=True):
    t = _defect(dim_time(b), planted, _dom("date_day", 21), rolling_7d_start=F.date_sub("rolling_7d_start", 1))
    return Q.predicates(t, _rules("dim_time", "dq_calendar_rolling"), ["date_day"])


@register("dq_recompute_ap_open", f"""
WITH e AS (
  SELECT coalesce(x.organization_id, y.organization_id) AS organization_id, coalesce(x.m, y.m) AS budget_month,
         (coalesce(x.c, 0) + coalesce(y.c, 0)) / 100.0 AS expected_value
  FROM (SELECT organization_id, CAST(date_trunc('month', coalesce(due_date, bill_date)) AS DATE) AS m,
               sum(CASE WHEN bill_status IN ('submitted', 'approved', 'scheduled') THEN amount_cents ELSE 0 END) AS c
        FROM fct_fin_bills GROUP BY 1, 2) x
  FULL OUTER JOIN (SELECT organization_id, adjusted_month AS m, sum(signed_amount_cents) AS c FROM fct_fin_bill_adjustments
                   GROUP BY 1, 2) y ON x.organization_id = y.organization_id AND x.m = y.m
  WHERE coalesce(x.m, y.m) <= DATE '2001-08-01'),
a AS (SELECT organization_id, budget_month, ap_open_usd + (month(budget_month) = 6)::INT AS actual_value FROM fin_budget_vs_actual WHERE ap_open_usd <> 0)
SELECT 'recompute_ap_open' AS check_name, coalesce(e.organization_id, a.organization_id) AS organization_id,
       coalesce(e.budget_month, a.budget_month) AS budget_month, e.expected_value, a.actual_value
FROM e FULL OUTER JOIN a ON e.organization_id = a.organization_id AND e.budget_month = a.budget_month
WHERE abs(coalesce(e.expected_value, 0) - coalesce(a.actual_value, 0)) > 0.01""",
          ("fct_fin_bills", "fct_fin_bill_adjustments", "fin_budget_vs_actual"))
def dq_recompute_ap_open(b, planted=True):
    bills = fct_fin_bills(b)
    x = bills.groupBy("organization_id", month_start(F.coalesce("due_date", "bill_date")).alias("budget_month")).agg(
        F.sum(F.when(F.col("bill_status").isin("submitted", "approved", "scheduled"), F.col("amount_cents"))
              .otherwise(0)).alias("_x"))
    y = fct_fin_bill_adjustments(b).groupBy("organization_id", F.col("adjusted_month").alias("budget_month")) \
        .agg(F.sum("signed_amount_cents").alias("_y"))
    e = (x.join(y, ["organization_id", "budget_month"], "full")
         .filter(F.col("budget_month") <= F.lit(b.as_of).cast("date"))
         .select("organization_id", "budget_month",
                 ((F.coalesce("_x", F.lit(0)) + F.coalesce("_y", F.lit(0))) / 100.0).alias("v")))
    a = fin_budget_vs_actual(b).filter(F.col("ap_open_usd") != 0).select("organization_id", "budget_month",
                                                                         F.col("ap_open_usd").alias("v"))
    a = _defect(a, planted, F.month("budget_month") == 6, v=F.col("v") + 1)
    return Q.recompute_compare(e, a, ["organization_id", "budget_month"], "v", 0.01, "recompute_ap_open")


@register("dq_recompute_net_spend", """
WITH p AS (SELECT organization_id, paid_month AS spend_month,
                  sum(CASE WHEN payment_status = 'paid' THEN amount_cents ELSE 0 END) AS g FROM fct_fin_bill_payments GROUP BY 1, 2),
r AS (SELECT organization_id, reversed_month AS spend_month,
             sum(CASE WHEN reversal_status = 'completed' THEN reversal_amount_cents ELSE 0 END) AS r
      FROM fct_fin_payment_reversals GROUP BY 1, 2),
e AS (SELECT p.organization_id, p.spend_month, (p.g - coalesce(r.r, 0)) / 100.0 AS expected_value
      FROM p LEFT JOIN r ON p.organization_id = r.organization_id AND p.spend_month = r.spend_month),
a AS (SELECT organization_id, spend_month, spend_usd + 0.5 * (month(spend_month) = 3)::INT AS actual_value FROM fin_spend_monthly WHERE spend_source = 'bill_payment')
SELECT 'recompute_net_spend' AS check_name, coalesce(e.organization_id, a.organization_id) AS organization_id,
       coalesce(e.spend_month, a.spend_month) AS spend_month, e.expected_value, a.actual_value
FROM e FULL OUTER JOIN a ON e.organization_id = a.organization_id AND e.spend_month = a.spend_month
WHERE abs(coalesce(e.expected_value, 0) - coalesce(a.actual_value, 0)) > 0.01""",
          ("fct_fin_bill_payments", "fct_fin_payment_reversals", "fin_spend_monthly"))
def dq_recompute_net_spend(b, planted=True):
    p = fct_fin_bill_payments(b).groupBy("organization_id", F.col("paid_month").alias("spend_month")).agg(
        F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_cents")).otherwise(0)).alias("_g"))
    r = fct_fin_payment_reversals(b).groupBy("organization_id", F.col("reversed_month").alias("spend_month")).agg(
        F.sum(F.when(F.col("reversal_status") == "completed", F.col("reversal_amount_cents")).otherwise(0)).alias("_r"))
    e = p.join(r, ["organization_id", "spend_month"], "left").select(
        "organization_id", "spend_month", ((F.col("_g") - F.coalesce("_r", F.lit(0))) / 100.0).alias("v"))
    a = fin_spend_monthly(b).filter(F.col("spend_source") == "bill_payment").select(
        "organization_id", "spend_month", F.col("spend_usd").alias("v"))
    a = _defect(a, planted, F.month("spend_month") == 3, v=F.col("v") + 0.5)
    return Q.recompute_compare(e, a, ["organization_id", "spend_month"], "v", 0.01, "recompute_net_spend")


@register("dq_reversal_cap", """SELECT 'reversal_cap' AS check_name, p.bill_payment_id, p.amount_cents, r.reversed_cents
FROM fct_fin_bill_payments p JOIN (SELECT bill_payment_id, CAST(sum(reversal_amount_cents) AS BIGINT) AS reversed_cents
  FROM fct_fin_payment_reversals WHERE reversal_status = 'completed' GROUP BY 1) r ON p.bill_payment_id = r.bill_payment_id
WHERE r.reversed_cents > p.amount_cents""", ("fct_fin_bill_payments", "fct_fin_payment_reversals"))
def dq_reversal_cap(b):
    r = (fct_fin_payment_reversals(b).filter(F.col("reversal_status") == "completed")
         .groupBy("bill_payment_id").agg(F.sum("reversal_amount_cents").alias("reversed_cents")))
    p = fct_fin_bill_payments(b).select("bill_payment_id", "amount_cents")
    v = p.join(r, "bill_payment_id").filter(F.col("reversed_cents") > F.col("amount_cents"))
    return v.select(F.lit("reversal_cap").alias("check_name"), "bill_payment_id", "amount_cents", "reversed_cents")


@register("dq_coverage", """SELECT 'coverage' AS check_name, q.task_id FROM gtm_task_queue q
LEFT JOIN gtm_action_log a ON q.task_id = a.task_id WHERE a.task_id IS NULL""", ("gtm_task_queue", "gtm_action_log"))
def dq_coverage(b):
    q = gtm_task_queue(b).select("task_id")
    return q.join(gtm_action_log(b).select("task_id"), "task_id", "left_anti") \
        .select(F.lit("coverage").alias("check_name"), "task_id")


@register("dq_status_consistency", """SELECT 'status_consistency' AS check_name, action_id, status, error_message
FROM (SELECT * REPLACE (if(status = 'failed', NULL, 'unexpected') AS error_message) FROM gtm_action_log)
WHERE (status = 'success' AND error_message IS NOT NULL) OR (status = 'failed' AND error_message IS NULL)""",
          ("gtm_action_log",))
def dq_status_consistency(b, planted=True):
    a = _defect(gtm_action_log(b), planted, F.lit(True), error_message=F.when(F.col("status") != "failed", F.lit("unexpected")))
    return Q.predicates(a, _rules("gtm_action_log", "dq_status_consistency"), ["action_id", "status", "error_message"])


@register("dq_threshold_enforced", """SELECT 'threshold_enforced' AS check_name, q.task_id, q.signal_score
FROM (SELECT task_id, if(organization_id % 3 = 0, signal_score / 2, signal_score) AS signal_score FROM gtm_task_queue) q
CROSS JOIN (SELECT threshold_value FROM gtm_signal_thresholds WHERE threshold_name = 'high_risk' AND is_active) t
WHERE q.signal_score < t.threshold_value""", ("gtm_task_queue", "gtm_signal_thresholds"))
def dq_threshold_enforced(b, planted=True):
    from .growth import signal_thresholds
    t = (signal_thresholds(b.spark).filter((F.col("threshold_name") == "high_risk") & F.col("is_active"))
         .select("threshold_value").scalar())  # the one active threshold of the configuration
    q = _defect(gtm_task_queue(b), planted, F.col("organization_id") % 3 == 0, signal_score=F.col("signal_score") / 2)
    return q.filter(F.col("signal_score") < t) \
        .select(F.lit("threshold_enforced").alias("check_name"), "task_id", "signal_score")


@register("dq_freshness", f"""
SELECT table_name, layer, max_ts, row_count, round(date_diff('second', max_ts, {AS_OF_TS_SQL}) / 3600.0, 2) AS age_hours,
       threshold_hours,
       row_count = 0 OR max_ts IS NULL OR round(date_diff('second', max_ts, {AS_OF_TS_SQL}) / 3600.0, 2) > threshold_hours AS is_stale
FROM (SELECT 'orders' AS table_name, 'bronze' AS layer, max(o_orderdate) AS max_ts, count(*) AS row_count, CAST(24.0 AS DOUBLE) AS threshold_hours FROM orders
      UNION ALL SELECT 'lineitem', 'bronze', max(l_shipdate), count(*), CAST(24.0 AS DOUBLE) FROM lineitem
      UNION ALL SELECT 'fct_sessions', 'silver', max(created_at), count(*), CAST(24.0 AS DOUBLE) FROM fct_sessions
      UNION ALL SELECT 'fin_monthly_revenue', 'gold', CAST(max(revenue_month) AS TIMESTAMP), count(*), CAST(48.0 AS DOUBLE) FROM fin_monthly_revenue)""",
          ("fct_sessions", "fin_monthly_revenue"))
def dq_freshness(b):
    from .finance import fin_monthly_revenue
    tables = {"orders": (b.t.orders, "o_orderdate", "bronze"), "lineitem": (b.t.lineitem, "l_shipdate", "bronze"),
              "fct_sessions": (fct_sessions(b), "created_at", "silver"),
              "fin_monthly_revenue": (fin_monthly_revenue(b).withColumn("_ts", F.col("revenue_month")
                                                                        .cast("timestamp_ntz")), "_ts", "gold")}
    return Q.freshness(tables, FRESHNESS_HOURS, f"{b.as_of} 00:00:00")


@register("dq_completeness", f"""SELECT 'completeness' AS check_name, column_name, non_null_share FROM (
  SELECT 'current_plan_name' AS column_name, round(avg(CASE WHEN current_plan_name IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS non_null_share
  FROM pro_sessions_daily WHERE session_date >= {AS_OF_SQL} - INTERVAL 90 DAY
  UNION ALL SELECT 'median_duration_seconds', round(avg(CASE WHEN median_duration_seconds IS NOT NULL THEN 1.0 ELSE 0.0 END), 4)
  FROM pro_sessions_daily WHERE session_date >= {AS_OF_SQL} - INTERVAL 90 DAY) WHERE non_null_share < 0.95""",
          ("pro_sessions_daily",))
def dq_completeness(b):
    return Q.completeness(pro_sessions_daily(b), ["current_plan_name", "median_duration_seconds"], "session_date",
                          b.as_of, 90, 0.95)
