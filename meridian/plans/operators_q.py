"""Operator-level queries (filters, joins, aggregations, windows, sorts, sets,
scalar functions, spines), each a small data product over the bindings.

Every query here runs over the whole input tables; limits appear only where the
limit is the operator itself (top-k, latest row, paging, row/byte caps).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import (count_if, duration_bucket, exact_avg, exact_sum, initials, iso_yearweek, kv_extract,
                               month_start, safe_ratio, ts_on_or_after, url_domain, week_start)
from ..operators.shapes import (close_intervals, entity_day_spine, explode_months, latest_per_key, percentile_select, referenced,
                                rank_within, trailing_distinct_multi, union_calendar)
from ..operators import shapes
from .core import fct_sessions
from .finance import fin_monthly_revenue, subscription_history
from .oracle_views import AS_OF_SQL, AS_OF_TS_SQL
from .registry import register


def q(name: str, sql: str | None, *deps: str, inputs: tuple[str, ...] = ()):
    return register(name, sql, tuple(deps), inputs=inputs)


def _d(b):
    return F.lit(b.as_of).cast("date")


# =================================================================== filters
@q("flt_equality", "SELECT session_id, organization_id, status FROM b_sessions WHERE status = 'completed'", "b_sessions")
def flt_equality(b):
    return b.sessions.filter(F.col("status") == "completed").select("session_id", "organization_id", "status")


@q("flt_in_list", "SELECT bill_id, organization_id, bill_status FROM b_fin_bills "
   "WHERE bill_status IN ('submitted', 'approved', 'scheduled')", "b_fin_bills")
def flt_in_list(b):
    return b.fin_bills.filter(F.col("bill_status").isin("submitted", "approved", "scheduled")) \
        .select("bill_id", "organization_id", "bill_status")


@q("flt_not_in", "SELECT opportunity_id, account_id, stage, amount_usd FROM b_opportunities "
   "WHERE stage NOT IN ('closed_won', 'closed_lost')", "b_opportunities")
def flt_not_in(b):
    return b.opportunities.filter(~F.col("stage").isin("closed_won", "closed_lost")) \
        .select("opportunity_id", "account_id", "stage", "amount_usd")


@q("flt_trailing_window", f"SELECT session_id, organization_id, CAST(started_at AS DATE) AS session_date FROM b_sessions "
   f"WHERE CAST(started_at AS DATE) >= {AS_OF_SQL} - INTERVAL 30 DAY", "b_sessions")
def flt_trailing_window(b):
    d = F.to_date("started_at")
    return b.sessions.filter(ts_on_or_after("started_at", b.as_of, 30)) \
        .select("session_id", "organization_id", d.alias("session_date"))


@q("flt_trailing_months", f"SELECT organization_id, revenue_month, realized_revenue_usd FROM fin_monthly_revenue "
   f"WHERE revenue_month >= CAST(date_trunc('month', {AS_OF_SQL}) - INTERVAL 12 MONTH AS DATE)", "fin_monthly_revenue")
def flt_trailing_months(b):
    r = fin_monthly_revenue(b)
    return r.filter(F.col("revenue_month") >= F.add_months(F.trunc(_d(b), "MM"), -12)) \
        .select("organization_id", "revenue_month", "realized_revenue_usd")


@q("flt_prior_window", f"""
SELECT CASE WHEN CAST(started_at AS DATE) > {AS_OF_SQL} - INTERVAL 7 DAY THEN 'current' ELSE 'previous' END AS window_name,
       count(*) AS sessions, count(CASE WHEN status = 'completed' THEN 1 END) AS completed
FROM b_sessions
WHERE CAST(started_at AS DATE) > {AS_OF_SQL} - INTERVAL 14 DAY AND CAST(started_at AS DATE) <= {AS_OF_SQL}
GROUP BY 1""", "b_sessions")
def flt_prior_window(b):
    d = F.to_date("started_at")
    s = b.sessions.filter((d > F.date_sub(_d(b), 14)) & (d <= _d(b)))
    w = F.when(d > F.date_sub(_d(b), 7), F.lit("current")).otherwise(F.lit("previous"))
    return s.groupBy(w.alias("window_name")).agg(F.count(F.lit(1)).alias("sessions"),
                                                 count_if(F.col("status") == "completed").alias("completed"))


@q("flt_null_guard", "SELECT lead_id, account_id, converted_at FROM b_leads WHERE converted_at IS NOT NULL", "b_leads")
def flt_null_guard(b):
    return b.leads.filter(F.col("converted_at").isNotNull()).select("lead_id", "account_id", "converted_at")


@q("flt_or_mixed", f"SELECT subscription_id, organization_id, status FROM fct_subscriptions "
   f"WHERE is_in_trial = TRUE OR status = 'trialing'", "fct_subscriptions")
def flt_or_mixed(b):
    from .core import fct_subscriptions
    return fct_subscriptions(b).filter(F.col("is_in_trial") | (F.col("status") == "trialing")) \
        .select("subscription_id", "organization_id", "status")


@q("flt_like", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%widget%' OR p_type LIKE 'ECON%'")
def flt_like(b):
    return b.t.part.filter(F.col("p_name").like("%widget%") | F.col("p_type").like("ECON%")) \
        .select("p_partkey", "p_name", "p_type")


@q("flt_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def flt_between(b):
    return b.t.orders.filter(F.col("o_totalprice").between(100000, 200000)).select("o_orderkey", "o_totalprice")


@q("flt_null_safe_distinct", "SELECT account_id, organization_id FROM b_accounts "
   "WHERE organization_id IS DISTINCT FROM account_id", "b_accounts")
def flt_null_safe_distinct(b):
    return b.accounts.filter(~F.col("organization_id").eqNullSafe(F.col("account_id"))) \
        .select("account_id", "organization_id")


@q("flt_having", "SELECT organization_id, count(*) AS sessions FROM b_sessions GROUP BY 1 HAVING count(*) > 10",
   "b_sessions")
def flt_having(b):
    return b.sessions.groupBy("organization_id").agg(F.count(F.lit(1)).alias("sessions")) \
        .filter(F.col("sessions") > 10)


@q("flt_latest_period", "SELECT organization_id, revenue_month, realized_revenue_usd FROM fin_monthly_revenue "
   "WHERE revenue_month = (SELECT max(revenue_month) FROM fin_monthly_revenue)", "fin_monthly_revenue")
def flt_latest_period(b):
    r = fin_monthly_revenue(b)
    latest = r.agg(F.max("revenue_month").alias("revenue_month"))  # one row
    return r.join(latest, "revenue_month", "left_semi").select("organization_id", "revenue_month", "realized_revenue_usd")


# ===================================================================== joins
@q("jn_inner", """SELECT a.subscription_id, a.organization_id, p.plan_name, p.monthly_price_usd
FROM b_subscriptions a JOIN b_plans p ON a.plan_id = p.plan_id""", "b_subscriptions", "b_plans")
def jn_inner(b):
    return b.subscriptions.join(F.broadcast(b.plans), "plan_id") \
        .select("subscription_id", "organization_id", "plan_name", "monthly_price_usd")


@q("jn_left_enrich", """SELECT e.event_id, e.session_id, s.organization_id, s.project_id
FROM b_session_events e LEFT JOIN b_sessions s ON e.session_id = s.session_id""", "b_session_events", "b_sessions")
def jn_left_enrich(b):
    s = b.sessions.select("session_id", "organization_id", "project_id")
    return b.session_events.join(s, "session_id", "left").select("event_id", "session_id", "organization_id", "project_id")


@q("jn_left_multi_key", """SELECT r.organization_id, r.revenue_month, r.realized_revenue_usd, s.sessions
FROM fin_monthly_revenue r LEFT JOIN (SELECT organization_id, CAST(date_trunc('month', started_at) AS DATE) AS m,
                                             count(*) AS sessions FROM b_sessions GROUP BY 1, 2) s
  ON r.organization_id = s.organization_id AND r.revenue_month = s.m""", "fin_monthly_revenue", "b_sessions")
def jn_left_multi_key(b):
    s = b.sessions.groupBy("organization_id", month_start("started_at").alias("revenue_month")) \
        .agg(F.count(F.lit(1)).alias("sessions"))
    return fin_monthly_revenue(b).join(s, ["organization_id", "revenue_month"], "left") \
        .select("organization_id", "revenue_month", "realized_revenue_usd", "sessions")


@q("jn_chain_star", """
SELECT a.account_id, a.account_tier, coalesce(l.leads, 0) AS leads, coalesce(o.opps, 0) AS opps,
       coalesce(s.sessions, 0) AS sessions, coalesce(i.invoices, 0) AS invoices, e.full_name AS owner_name
FROM b_accounts a
LEFT JOIN (SELECT account_id, count(*) AS leads FROM b_leads GROUP BY 1) l ON a.account_id = l.account_id
LEFT JOIN (SELECT account_id, count(*) AS opps FROM b_opportunities GROUP BY 1) o ON a.account_id = o.account_id
LEFT JOIN (SELECT organization_id, count(*) AS sessions FROM b_sessions GROUP BY 1) s ON a.organization_id = s.organization_id
LEFT JOIN (SELECT organization_id, count(*) AS invoices FROM b_invoices GROUP BY 1) i ON a.organization_id = i.organization_id
LEFT JOIN b_employees e ON a.owner_employee_id = e.employee_id""",
   "b_accounts", "b_leads", "b_opportunities", "b_sessions", "b_invoices", "b_employees")
def jn_chain_star(b):
    """Star of pre-aggregated branches around one spine (no fan-out)."""
    a = b.accounts
    l = b.leads.groupBy("account_id").agg(F.count(F.lit(1)).alias("leads"))
    o = b.opportunities.groupBy("account_id").agg(F.count(F.lit(1)).alias("opps"))
    s = b.sessions.groupBy("organization_id").agg(F.count(F.lit(1)).alias("sessions"))
    i = b.invoices.groupBy("organization_id").agg(F.count(F.lit(1)).alias("invoices"))
    e = referenced(b.employees.select(F.col("employee_id").alias("owner_employee_id"), F.col("full_name").alias("owner_name")),
                   "owner_employee_id", (a, "owner_employee_id"))
    j = (a.join(l, "account_id", "left").join(o, "account_id", "left").join(s, "organization_id", "left")
         .join(i, "organization_id", "left").join(e, "owner_employee_id", "left"))
    return j.select("account_id", "account_tier", F.coalesce("leads", F.lit(0)).alias("leads"),
                    F.coalesce("opps", F.lit(0)).alias("opps"), F.coalesce("sessions", F.lit(0)).alias("sessions"),
                    F.coalesce("invoices", F.lit(0)).alias("invoices"), "owner_name")


@q("jn_role_playing", """
SELECT c.campaign_id, own.full_name AS campaign_owner, mgr.full_name AS owner_manager, mgr2.full_name AS manager_manager
FROM b_campaigns c
LEFT JOIN b_employees own ON c.owner_employee_id = own.employee_id
LEFT JOIN b_employees mgr ON own.manager_employee_id = mgr.employee_id
LEFT JOIN b_employees mgr2 ON mgr.manager_employee_id = mgr2.employee_id""", "b_campaigns", "b_employees")
def jn_role_playing(b):
    e = b.employees
    own, mgr, mgr2 = e.alias("own"), e.alias("mgr"), e.alias("mgr2")
    c = b.campaigns.alias("c")
    j = (c.join(own, F.col("c.owner_employee_id") == F.col("own.employee_id"), "left")
         .join(mgr, F.col("own.manager_employee_id") == F.col("mgr.employee_id"), "left")
         .join(mgr2, F.col("mgr.manager_employee_id") == F.col("mgr2.employee_id"), "left"))
    return j.select(F.col("c.campaign_id"), F.col("own.full_name").alias("campaign_owner"),
                    F.col("mgr.full_name").alias("owner_manager"), F.col("mgr2.full_name").alias("manager_manager"))


@q("jn_full_outer", """
SELECT coalesce(t.organization_id, r.organization_id) AS organization_id, coalesce(t.m, r.m) AS month,
       coalesce(t.card_cents, 0) AS card_cents, coalesce(r.reimb_cents, 0) AS reimb_cents
FROM (SELECT organization_id, CAST(date_trunc('month', transaction_at) AS DATE) AS m, CAST(sum(amount_cents) AS BIGINT) AS card_cents
      FROM b_fin_transactions GROUP BY 1, 2) t
FULL OUTER JOIN (SELECT organization_id, CAST(date_trunc('month', submitted_at) AS DATE) AS m, CAST(sum(amount_cents) AS BIGINT) AS reimb_cents
      FROM b_fin_reimbursements GROUP BY 1, 2) r ON t.organization_id = r.organization_id AND t.m = r.m""",
   "b_fin_transactions", "b_fin_reimbursements")
def jn_full_outer(b):
    t = b.fin_transactions.groupBy("organization_id", month_start("transaction_at").alias("month")) \
        .agg(F.sum("amount_cents").alias("card_cents"))
    r = b.fin_reimbursements.groupBy("organization_id", month_start("submitted_at").alias("month")) \
        .agg(F.sum("amount_cents").alias("reimb_cents"))
    return t.join(r, ["organization_id", "month"], "full").select(
        "organization_id", "month", F.coalesce("card_cents", F.lit(0)).alias("card_cents"),
        F.coalesce("reimb_cents", F.lit(0)).alias("reimb_cents"))


@q("jn_cross_scalar", """
SELECT s.organization_id, s.sessions, round(s.sessions::DOUBLE / t.total * 100, 4) AS share_pct
FROM (SELECT organization_id, count(*) AS sessions FROM b_sessions GROUP BY 1) s
CROSS JOIN (SELECT count(*) AS total FROM b_sessions) t""", "b_sessions")
def jn_cross_scalar(b):
    s = b.sessions.groupBy("organization_id").agg(F.count(F.lit(1)).alias("sessions"))
    total = b.sessions.agg(F.count(F.lit(1))).scalar()  # the one-row relation, attached as a scalar subquery
    return s.select("organization_id", "sessions", F.round(F.col("sessions") / total * 100, 4).alias("share_pct"))


@q("jn_cross_grid", f"""
SELECT p.plan_id, m.month
FROM b_plans p CROSS JOIN (SELECT DISTINCT CAST(date_trunc('month', started_at) AS DATE) AS month FROM b_sessions) m""",
   "b_plans", "b_sessions")
def jn_cross_grid(b):
    """Plan x observed month grid; the plan side is the bounded catalogue."""
    months = b.sessions.select(month_start("started_at").alias("month")).distinct()
    return months.crossJoin(F.broadcast(b.plans.select("plan_id"))).select("plan_id", "month")


@q("jn_theta_spine", f"""
SELECT o.organization_id, count(*) AS days_since_signup
FROM b_organizations o JOIN dim_time d ON d.date_day >= CAST(o.created_at AS DATE) AND d.date_day <= {AS_OF_SQL}
GROUP BY 1""", "b_organizations", "dim_time")
def jn_theta_spine(b):
    """Cross join + range filter rewritten as a per-row explode (output-sized)."""
    from .core import dim_time
    d0 = dim_time(b).agg(F.min("date_day")).scalar()  # scalar subquery
    sp = entity_day_spine(b.organizations, "organization_id", F.greatest(F.to_date("created_at"), d0), _d(b))
    return sp.groupBy("organization_id").agg(F.count(F.lit(1)).alias("days_since_signup"))


@q("jn_theta_threshold", """
SELECT s.organization_id, t.threshold_name, s.signal_score FROM gtm_trial_risk s
JOIN gtm_signal_thresholds t ON s.signal_score >= t.threshold_value WHERE t.is_active""",
   "gtm_trial_risk", "gtm_signal_thresholds")
def jn_theta_threshold(b):
    from .growth import gtm_trial_risk, signal_thresholds
    t = F.broadcast(signal_thresholds(b.spark).filter("is_active"))  # bounded configuration
    return gtm_trial_risk(b).join(t, F.col("signal_score") >= F.col("threshold_value")) \
        .select("organization_id", "threshold_name", "signal_score")


def _asof_sessions(b):
    """Session -> containing subscription interval via (org, month) equi-join."""
    hist = subscription_history(b.subscriptions, b.plans)
    s = b.sessions.select("session_id", "organization_id", "started_at")
    return shapes.bucketed_asof(s, hist, "organization_id", "started_at", "effective_start_ts", "effective_end_ts",
                                ["subscription_id", "plan_name"])


@q("jn_interval", """SELECT s.session_id, sh.subscription_id FROM b_sessions s
JOIN sub_history sh ON s.organization_id = sh.organization_id
 AND s.started_at >= sh.effective_start_ts AND s.started_at <= sh.effective_end_ts""", "b_sessions", "sub_history")
def jn_interval(b):
    return _asof_sessions(b).filter(F.col("subscription_id").isNotNull()).select("session_id", "subscription_id")


@q("jn_asof_latest", """SELECT session_id, subscription_id, plan_name FROM (
  SELECT s.session_id, sh.subscription_id, sh.plan_name,
         row_number() OVER (PARTITION BY s.session_id ORDER BY sh.effective_start_ts DESC, sh.subscription_id DESC) AS rn
  FROM b_sessions s LEFT JOIN sub_history sh ON s.organization_id = sh.organization_id
   AND s.started_at >= sh.effective_start_ts AND s.started_at <= sh.effective_end_ts) WHERE rn = 1""",
   "b_sessions", "sub_history")
def jn_asof_latest(b):
    """Latest containing interval per session (closed intervals are disjoint,
    so the bucketed equi-join yields at most one match)."""
    return _asof_sessions(b).select("session_id", "subscription_id", "plan_name")


@q("jn_interval_overlap", """
SELECT u.organization_id, u.period_start, count(sh.subscription_id) AS overlapping_subscriptions
FROM b_usage_records u LEFT JOIN sub_history sh ON u.organization_id = sh.organization_id
 AND CAST(sh.effective_start_ts AS DATE) <= u.period_end AND CAST(sh.effective_end_ts AS DATE) >= u.period_start
GROUP BY 1, 2""", "b_usage_records", "sub_history")
def jn_interval_overlap(b):
    """Overlap join as equi-join on (org, first common month) + range residual."""
    u = b.usage_records.select("organization_id", "period_start", "period_end")
    hist = subscription_history(b.subscriptions, b.plans).select(
        "organization_id", "subscription_id", F.to_date("effective_start_ts").alias("_s"),
        F.to_date("effective_end_ts").alias("_e"))
    pairs = shapes.bucketed_overlap(u, hist, "organization_id", "period_start", "period_end", "_s", "_e",
                                    ["subscription_id"])
    n = pairs.groupBy("organization_id", "period_start").agg(F.count("subscription_id").alias("_n"))
    return (u.select("organization_id", "period_start").join(n, ["organization_id", "period_start"], "left")
            .select("organization_id", "period_start",
                    F.coalesce("_n", F.lit(0)).alias("overlapping_subscriptions")))


@q("jn_range_between", """
SELECT u.organization_id, u.period_start, count(s.session_id) AS ledger_sessions
FROM b_usage_records u LEFT JOIN b_sessions s ON s.organization_id = u.organization_id
 AND CAST(s.created_at AS DATE) BETWEEN u.period_start AND u.period_end GROUP BY 1, 2""",
   "b_usage_records", "b_sessions")
def jn_range_between(b):
    """Sessions pre-aggregated per (org, day), then joined on (org, month) + between."""
    daily = b.sessions.groupBy(F.col("organization_id").alias("_o"), F.to_date("created_at").alias("_d")) \
        .agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", F.trunc("_d", "MM"))
    u = explode_months(b.usage_records.select("organization_id", "period_start", "period_end"),
                       "period_start", "period_end", None, "_pm")
    j = u.join(daily, (u.organization_id == daily._o) & (u._pm == daily._m)
               & (daily._d >= u.period_start) & (daily._d <= u.period_end), "left")
    return j.groupBy("organization_id", "period_start").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("ledger_sessions"))


@q("jn_date_bucket", """
SELECT q.task_id, count(a.activity_id) AS same_day_activities
FROM gtm_task_queue q LEFT JOIN b_activities a
  ON q.organization_id = a.account_id AND CAST(q.created_at AS DATE) = CAST(a.occurred_at AS DATE) GROUP BY 1""",
   "gtm_task_queue", "b_activities")
def jn_date_bucket(b):
    from .growth import gtm_task_queue
    qd = gtm_task_queue(b).select("task_id", "organization_id", F.to_date("created_at").alias("_d"))
    a = b.activities.select(F.col("account_id").alias("organization_id"), F.to_date("occurred_at").alias("_d"),
                            "activity_id")
    return qd.join(a, ["organization_id", "_d"], "left").groupBy("task_id") \
        .agg(F.count("activity_id").alias("same_day_activities"))


@q("jn_month_rollup_lookup", """
SELECT s.session_id, r.realized_revenue_usd FROM b_sessions s LEFT JOIN fin_monthly_revenue r
  ON s.organization_id = r.organization_id AND CAST(date_trunc('month', s.started_at) AS DATE) = r.revenue_month""",
   "b_sessions", "fin_monthly_revenue")
def jn_month_rollup_lookup(b):
    s = b.sessions.select("session_id", "organization_id", month_start("started_at").alias("revenue_month"))
    r = fin_monthly_revenue(b).select("organization_id", "revenue_month", "realized_revenue_usd")
    return s.join(r, ["organization_id", "revenue_month"], "left").select("session_id", "realized_revenue_usd")


@q("jn_anti_null", """SELECT organization_id FROM b_organizations WHERE organization_id NOT IN (
  SELECT organization_id FROM b_sessions WHERE started_at >= TIMESTAMP '2001-06-01' AND organization_id IS NOT NULL)""",
   "b_organizations", "b_sessions")
def jn_anti_null(b):
    """Organisations without a session in the last two months of the data."""
    recent = b.sessions.filter(F.col("started_at") >= F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"))
    return b.organizations.select("organization_id").join(recent.select("organization_id"), "organization_id", "left_anti")


@q("jn_tie_out", """
SELECT coalesce(a.k, m.k) AS tie_key, a.v AS mart_value, m.v AS metric_value,
       CASE WHEN a.k IS NULL THEN 'missing_in_mart' WHEN m.k IS NULL THEN 'missing_in_metric'
            WHEN abs(a.v - m.v) <= 0.01 THEN 'match' ELSE 'mismatch' END AS tie_status,
       round(coalesce(a.v, 0) - coalesce(m.v, 0), 2) AS delta
FROM (SELECT CAST(metric_date AS VARCHAR) AS k, CAST(total_sessions AS DOUBLE) AS v FROM eng_daily) a
FULL OUTER JOIN (SELECT CAST(date AS VARCHAR) AS k, TRY_CAST(CAST(total_sessions AS VARCHAR) AS DOUBLE) AS v
                 FROM core_daily_kpis) m ON a.k = m.k""", "eng_daily", "core_daily_kpis")
def jn_tie_out(b):
    from .product import eng_daily
    from .terminal import core_daily_kpis
    a = eng_daily(b).select(F.col("metric_date").cast("string").alias("k"), F.col("total_sessions").cast("double").alias("av"))
    m = core_daily_kpis(b).select(F.col("date").cast("string").alias("k2"),
                                  F.col("total_sessions").cast("string").try_cast("double").alias("mv"))
    j = a.join(m, F.col("k") == F.col("k2"), "full")
    st = (F.when(F.col("k").isNull(), "missing_in_mart").when(F.col("k2").isNull(), "missing_in_metric")
          .when(F.abs(F.col("av") - F.col("mv")) <= 0.01, "match").otherwise("mismatch"))
    return j.select(F.coalesce("k", "k2").alias("tie_key"), F.col("av").alias("mart_value"),
                    F.col("mv").alias("metric_value"), st.alias("tie_status"),
                    F.round(F.coalesce("av", F.lit(0.0)) - F.coalesce("mv", F.lit(0.0)), 2).alias("delta"))


@q("jn_case_insensitive", """SELECT r.organization_id, r.revenue_month, p.plan_id FROM fin_monthly_revenue r
JOIN b_plans p ON lower(r.current_plan_name) = lower(p.display_name)""", "fin_monthly_revenue", "b_plans")
def jn_case_insensitive(b):
    p = F.broadcast(b.plans.select("plan_id", F.lower("display_name").alias("_k")))
    r = fin_monthly_revenue(b).withColumn("_k", F.lower("current_plan_name"))
    return r.join(p, "_k").select("organization_id", "revenue_month", "plan_id")


@q("jn_lateral_series", f"""
SELECT s.subscription_id, count(*) AS active_days FROM b_subscriptions s,
  LATERAL (SELECT unnest(generate_series(CAST(s.current_period_start AS DATE),
           least(CAST(s.current_period_end AS DATE), {AS_OF_SQL}), INTERVAL 1 DAY))) g
WHERE CAST(s.current_period_start AS DATE) <= least(CAST(s.current_period_end AS DATE), {AS_OF_SQL})
GROUP BY 1""", "b_subscriptions")
def jn_lateral_series(b):
    s = b.subscriptions
    end = F.least(F.to_date("current_period_end"), _d(b))
    e = s.filter(F.to_date("current_period_start") <= end).select(
        "subscription_id", F.explode(F.sequence(F.to_date("current_period_start"), end)).alias("d"))
    return e.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("active_days"))


# ============================================================== aggregations
@q("agg_group", """SELECT organization_id, count(*) AS sessions, CAST(sum(duration_seconds) AS BIGINT) AS total_duration,
       min(started_at) AS first_started, max(started_at) AS last_started, round(avg(duration_seconds), 4) AS avg_duration
FROM b_sessions GROUP BY 1""", "b_sessions")
def agg_group(b):
    return b.sessions.groupBy("organization_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("duration_seconds").alias("total_duration"),
        F.min("started_at").alias("first_started"), F.max("started_at").alias("last_started"),
        F.round(F.avg("duration_seconds"), 4).alias("avg_duration"))


@q("agg_global", """SELECT count(*) AS invoices, CAST(sum(total_cents) AS BIGINT) AS total_cents, min(period_start) AS first_period,
       max(period_start) AS last_period, count(DISTINCT organization_id) AS customers FROM b_invoices""", "b_invoices")
def agg_global(b):
    return b.invoices.agg(F.count(F.lit(1)).alias("invoices"), F.sum("total_cents").alias("total_cents"),
                          F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"),
                          F.countDistinct("organization_id").alias("customers"))


@q("agg_count_if", """SELECT CAST(event_at AS DATE) AS event_date, count(CASE WHEN event_type = 'navigation' THEN 1 END) AS navigations,
       count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors
FROM b_session_events GROUP BY 1""", "b_session_events")
def agg_count_if(b):
    e = b.session_events
    return e.groupBy(F.to_date("event_at").alias("event_date")).agg(
        *[count_if(F.col("event_type") == t).alias(n) for t, n in
          (("navigation", "navigations"), ("click", "clicks"), ("error", "errors"))])


@q("agg_sum_if", """SELECT organization_id, CAST(sum(CASE WHEN invoice_status = 'paid' THEN total_cents ELSE 0 END) AS BIGINT) AS paid_cents,
       CAST(sum(CASE WHEN invoice_status = 'open' THEN total_cents ELSE 0 END) AS BIGINT) AS open_cents FROM b_invoices GROUP BY 1""",
   "b_invoices")
def agg_sum_if(b):
    i = b.invoices
    return i.groupBy("organization_id").agg(
        F.sum(F.when(F.col("invoice_status") == "paid", F.col("total_cents")).otherwise(0)).alias("paid_cents"),
        F.sum(F.when(F.col("invoice_status") == "open", F.col("total_cents")).otherwise(0)).alias("open_cents"))


@q("agg_filter_clause", """SELECT CAST(date_trunc('week', created_at) AS DATE) AS signup_week, count(*) AS signups,
       count(*) FILTER (WHERE status = 'active') AS active_signups FROM b_organizations GROUP BY 1""", "b_organizations")
def agg_filter_clause(b):
    o = b.organizations
    return o.groupBy(week_start("created_at").alias("signup_week")).agg(
        F.count(F.lit(1)).alias("signups"), F.count_if(F.col("status") == "active").alias("active_signups"))


@q("agg_count_distinct", """SELECT CAST(started_at AS DATE) AS d, count(DISTINCT organization_id) AS active_orgs
FROM b_sessions GROUP BY 1""", "b_sessions")
def agg_count_distinct(b):
    return b.sessions.groupBy(F.to_date("started_at").alias("d")).agg(F.countDistinct("organization_id").alias("active_orgs"))


@q("agg_multi_distinct", """SELECT session_month, count(DISTINCT organization_id) AS orgs, count(DISTINCT initial_domain) AS domains,
       count(DISTINCT browser_type) AS browsers FROM fct_sessions GROUP BY 1""", "fct_sessions")
def agg_multi_distinct(b):
    return fct_sessions(b).groupBy("session_month").agg(
        F.countDistinct("organization_id").alias("orgs"), F.countDistinct("initial_domain").alias("domains"),
        F.countDistinct("browser_type").alias("browsers"))


@q("agg_distinct_if", """SELECT CAST(date_trunc('month', current_period_start) AS DATE) AS m,
       count(DISTINCT CASE WHEN plan_id <> 'free' THEN organization_id END) AS paying_orgs,
       count(DISTINCT CASE WHEN plan_id = 'enterprise' THEN organization_id END) AS enterprise_orgs
FROM b_subscriptions GROUP BY 1""", "b_subscriptions")
def agg_distinct_if(b):
    s = b.subscriptions
    return s.groupBy(month_start("current_period_start").alias("m")).agg(
        F.countDistinct(F.when(F.col("plan_id") != "free", F.col("organization_id"))).alias("paying_orgs"),
        F.countDistinct(F.when(F.col("plan_id") == "enterprise", F.col("organization_id"))).alias("enterprise_orgs"))


@q("agg_percentile", """SELECT session_month, round(quantile_cont(duration_seconds::DOUBLE, 0.5), 2) AS p50,
       round(quantile_cont(duration_seconds::DOUBLE, 0.95), 2) AS p95, round(quantile_cont(duration_seconds::DOUBLE, 0.99), 2) AS p99
FROM fct_sessions WHERE duration_seconds IS NOT NULL GROUP BY 1""", "fct_sessions")
def agg_percentile(b):
    return percentile_select(fct_sessions(b), ["session_month"], "duration_seconds", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@q("agg_min_max_if", """SELECT account_id, min(CASE WHEN lead_status = 'converted' THEN converted_at END) AS first_converted_at,
       max(CASE WHEN lead_source = 'inbound' THEN created_at END) AS last_inbound_at FROM b_leads GROUP BY 1""", "b_leads")
def agg_min_max_if(b):
    l = b.leads
    return l.groupBy("account_id").agg(
        F.min(F.when(F.col("lead_status") == "converted", F.col("converted_at"))).alias("first_converted_at"),
        F.max(F.when(F.col("lead_source") == "inbound", F.col("created_at"))).alias("last_inbound_at"))


@q("agg_any_value_max", """SELECT organization_id, max(organization_name) AS organization_name,
       CAST(sum(invoice_count) AS BIGINT) AS invoices FROM fin_monthly_revenue GROUP BY 1""", "fin_monthly_revenue")
def agg_any_value_max(b):
    return fin_monthly_revenue(b).groupBy("organization_id").agg(
        F.max("organization_name").alias("organization_name"), F.sum("invoice_count").alias("invoices"))


@q("agg_bool_flag", """SELECT organization_id, max(CASE WHEN proxy_type IS NOT NULL THEN 1 ELSE 0 END) AS used_proxy_ever,
       bool_or(is_stealth_mode) AS used_stealth_ever FROM b_sessions GROUP BY 1""", "b_sessions")
def agg_bool_flag(b):
    s = b.sessions
    return s.groupBy("organization_id").agg(
        F.max(F.when(F.col("proxy_type").isNotNull(), 1).otherwise(0)).alias("used_proxy_ever"),
        F.bool_or("is_stealth_mode").alias("used_stealth_ever"))


@q("agg_avg_nullif", """SELECT organization_id, round(avg(nullif(pages_visited % 7, 0)), 4) AS avg_nonzero_pages
FROM b_sessions GROUP BY 1""", "b_sessions")
def agg_avg_nullif(b):
    return b.sessions.groupBy("organization_id").agg(
        F.round(F.avg(F.nullif(F.col("pages_visited") % 7, F.lit(0))), 4).alias("avg_nonzero_pages"))


@q("agg_dedupe", """SELECT DISTINCT organization_id, CAST(date_trunc('week', started_at) AS DATE) AS activity_week
FROM b_sessions""", "b_sessions")
def agg_dedupe(b):
    return b.sessions.select("organization_id", week_start("started_at").alias("activity_week")).distinct()


@q("agg_safe_ratio", """SELECT organization_id,
       round(count(CASE WHEN status = 'completed' THEN 1 END)::DOUBLE / nullif(count(*), 0) * 100, 2) AS success_pct,
       round(count(CASE WHEN status = 'timeout' THEN 1 END)::DOUBLE / nullif(count(CASE WHEN status = 'failed' THEN 1 END), 0) * 100, 2)
         AS timeout_to_failed_pct FROM b_sessions GROUP BY 1""", "b_sessions")
def agg_safe_ratio(b):
    st = F.col("status")
    return b.sessions.groupBy("organization_id").agg(
        safe_ratio(count_if(st == "completed"), F.count(F.lit(1))).alias("success_pct"),
        safe_ratio(count_if(st == "timeout"), count_if(st == "failed")).alias("timeout_to_failed_pct"))


@q("agg_reaggregate", f"""SELECT CAST(sum(total_sessions) AS BIGINT) AS sessions_30d, max(total_sessions) AS peak_daily_sessions,
       round(sum(CAST(round(success_rate_pct * 100) AS BIGINT)) / 100.0 / nullif(count(success_rate_pct), 0), 2) AS avg_success_rate_pct, CAST(sum(total_errors) AS BIGINT) AS errors_30d
FROM pro_sessions_daily WHERE session_date >= {AS_OF_SQL} - INTERVAL 30 DAY""", "pro_sessions_daily")
def agg_reaggregate(b):
    from .product import pro_sessions_daily
    d = pro_sessions_daily(b).filter(F.col("session_date") >= F.date_sub(_d(b), 30))
    return d.agg(F.sum("total_sessions").alias("sessions_30d"), F.max("total_sessions").alias("peak_daily_sessions"),
                 F.round(exact_avg("success_rate_pct", 2), 2).alias("avg_success_rate_pct"),
                 F.sum("total_errors").alias("errors_30d"))


@q("agg_net_of_reversal", """
SELECT p.m AS month, CAST(p.gross_cents AS BIGINT) AS gross_cents, CAST(coalesce(r.rev_cents, 0) AS BIGINT) AS reversed_cents,
       CAST(p.gross_cents - coalesce(r.rev_cents, 0) AS BIGINT) AS net_cents
FROM (SELECT CAST(date_trunc('month', coalesce(paid_at, created_at)) AS DATE) AS m,
             sum(CASE WHEN payment_status = 'paid' THEN amount_cents ELSE 0 END) AS gross_cents FROM b_fin_bill_payments GROUP BY 1) p
LEFT JOIN (SELECT CAST(date_trunc('month', reversed_at) AS DATE) AS m,
                  sum(CASE WHEN reversal_status = 'completed' THEN reversal_amount_cents ELSE 0 END) AS rev_cents
           FROM b_fin_payment_reversals GROUP BY 1) r ON p.m = r.m""", "b_fin_bill_payments", "b_fin_payment_reversals")
def agg_net_of_reversal(b):
    p = b.fin_bill_payments.groupBy(month_start(F.coalesce("paid_at", "created_at")).alias("month")).agg(
        F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_cents")).otherwise(0)).alias("gross_cents"))
    r = b.fin_payment_reversals.groupBy(month_start("reversed_at").alias("month")).agg(
        F.sum(F.when(F.col("reversal_status") == "completed", F.col("reversal_amount_cents")).otherwise(0)).alias("rc"))
    return p.join(r, "month", "left").select("month", "gross_cents", F.coalesce("rc", F.lit(0)).alias("reversed_cents"),
                                             (F.col("gross_cents") - F.coalesce("rc", F.lit(0))).alias("net_cents"))


@q("agg_groupby_expr_ordinal", """SELECT CAST(year(started_at) AS INTEGER) AS session_year, upper(browser_type) AS browser, count(*) AS sessions
FROM b_sessions GROUP BY 1, 2""", "b_sessions")
def agg_groupby_expr_ordinal(b):
    return b.sessions.groupBy(F.year("started_at").alias("session_year"), F.upper("browser_type").alias("browser")) \
        .agg(F.count(F.lit(1)).alias("sessions"))


@q("agg_blended_total", """
SELECT metric_month, CASE WHEN GROUPING(plan) = 1 THEN 'blended' ELSE plan END AS plan,
       count(DISTINCT organization_id) AS customers,
       sum(CAST(round(total_session_hours * 1000000) AS BIGINT)) / 1000000.0 AS session_hours,
       CASE WHEN max(CASE WHEN entitled_hours_monthly_prorated IS NULL THEN 1 ELSE 0 END) = 1 THEN NULL
            ELSE sum(CAST(round(entitled_hours_monthly_prorated * 10000) AS BIGINT)) / 10000.0 END AS capacity_hours
FROM (SELECT *, coalesce(primary_plan_name, 'none') AS plan FROM fin_cue)
GROUP BY ROLLUP (metric_month, plan) HAVING metric_month IS NOT NULL""", "fin_cue")
def agg_blended_total(b):
    """Per month x plan plus a blended month total (``rollup``); capacity is
    NULL whenever an unlimited (NULL-entitlement) customer is in the group."""
    from .finance import fin_customer_unit_economics
    c = fin_customer_unit_economics(b).withColumn("plan", F.coalesce("primary_plan_name", F.lit("none")))
    r = c.rollup("metric_month", "plan").agg(
        F.grouping("plan").alias("_g"), F.countDistinct("organization_id").alias("customers"),
        exact_sum("total_session_hours", 6).alias("session_hours"),
        F.when(F.max(F.when(F.col("entitled_hours_monthly_prorated").isNull(), 1).otherwise(0)) == 1,
               F.lit(None).cast("double"))
         .otherwise(exact_sum("entitled_hours_monthly_prorated", 4)).alias("capacity_hours"))
    return r.filter(F.col("metric_month").isNotNull()).select(
        "metric_month", F.when(F.col("_g") == 1, F.lit("blended")).otherwise(F.col("plan")).alias("plan"),
        "customers", "session_hours", "capacity_hours")


# =================================================================== windows
@q("win_latest_per_key", """SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT o_custkey, o_orderkey, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def win_latest_per_key(b):
    return latest_per_key(b.t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"],
                          [("o_orderdate", "desc"), ("o_orderkey", "desc")])


@q("win_first_per_key", """SELECT organization_id, session_id, started_at FROM (
  SELECT organization_id, session_id, started_at,
         row_number() OVER (PARTITION BY organization_id ORDER BY started_at, session_id) AS rn FROM b_sessions) WHERE rn = 1""",
   "b_sessions")
def win_first_per_key(b):
    return latest_per_key(b.sessions.select("organization_id", "session_id", "started_at"), ["organization_id"],
                          [("started_at", "asc"), ("session_id", "asc")])


@q("win_qualify", """SELECT bill_payment_id, payment_reversal_id, reversed_at FROM (
  SELECT bill_payment_id, payment_reversal_id, reversed_at,
         row_number() OVER (PARTITION BY bill_payment_id ORDER BY reversed_at DESC, payment_reversal_id ASC) AS rn
  FROM fct_fin_payment_reversals) WHERE rn = 1""", "fct_fin_payment_reversals")
def win_qualify(b):
    """QUALIFY row_number() = 1 as an aggregate: raw rows are reduced before they travel."""
    from .finance_ops import fct_fin_payment_reversals
    r = fct_fin_payment_reversals(b).select("bill_payment_id", "payment_reversal_id", "reversed_at")
    return latest_per_key(r, ["bill_payment_id"], [("reversed_at", "desc"), ("payment_reversal_id", "asc")])


@q("win_rank_over_agg", """SELECT organization_id, session_month, browser_type AS modal_browser FROM (
  SELECT organization_id, session_month, browser_type,
         row_number() OVER (PARTITION BY organization_id, session_month ORDER BY count(*) DESC, browser_type) AS rn
  FROM fct_sessions GROUP BY 1, 2, 3) WHERE rn = 1""", "fct_sessions")
def win_rank_over_agg(b):
    c = fct_sessions(b).groupBy("organization_id", "session_month", "browser_type").agg(F.count(F.lit(1)).alias("_n"))
    top = latest_per_key(c, ["organization_id", "session_month"], [("_n", "desc"), ("browser_type", "asc")])
    return top.select("organization_id", "session_month", F.col("browser_type").alias("modal_browser"))


@q("win_lead_interval_end", """
SELECT organization_id, subscription_id, effective_start_date,
       CAST(coalesce(least(raw_end_date, lead(effective_start_date) OVER (PARTITION BY organization_id
            ORDER BY effective_start_date, subscription_id) - INTERVAL 1 DAY), raw_end_date) AS DATE) AS effective_end_date
FROM (SELECT organization_id, subscription_id, CAST(coalesce(current_period_start, created_at) AS DATE) AS effective_start_date,
             CAST(coalesce(current_period_end, TIMESTAMP '2999-12-31 00:00:00') AS DATE) AS raw_end_date FROM b_subscriptions)""",
   "b_subscriptions")
def win_lead_interval_end(b):
    s = b.subscriptions.select(
        "organization_id", "subscription_id",
        F.to_date(F.coalesce("current_period_start", "created_at")).alias("effective_start_date"),
        F.to_date(F.coalesce(F.col("current_period_end"), F.lit("2999-12-31 00:00:00").cast("timestamp_ntz")))
         .alias("raw_end_date"))
    return close_intervals(s, ["organization_id"], "effective_start_date", "raw_end_date",
                           [("effective_start_date", "asc"), ("subscription_id", "asc")], "INTERVAL 1 DAY",
                           "effective_end_date").drop("raw_end_date")


@q("win_lag_growth", """SELECT organization_id, revenue_month, realized_revenue_usd,
       round((realized_revenue_usd - lag(realized_revenue_usd) OVER w) / nullif(lag(realized_revenue_usd) OVER w, 0) * 100, 2)
         AS mom_growth_pct
FROM fin_monthly_revenue WINDOW w AS (PARTITION BY organization_id ORDER BY revenue_month)""", "fin_monthly_revenue")
def win_lag_growth(b):
    from ..operators.shapes import period_growth
    r = fin_monthly_revenue(b).select("organization_id", "revenue_month", "realized_revenue_usd")
    return period_growth(r, ["organization_id"], "revenue_month", "realized_revenue_usd", "mom_growth_pct")


@q("win_priority_pick", """SELECT organization_id, subscription_id, status FROM (
  SELECT organization_id, subscription_id, status,
         row_number() OVER (PARTITION BY organization_id ORDER BY CASE status WHEN 'active' THEN 1 WHEN 'trialing' THEN 2 ELSE 3 END,
                            current_period_start DESC, subscription_id DESC) AS rn FROM b_subscriptions) WHERE rn = 1""",
   "b_subscriptions")
def win_priority_pick(b):
    s = b.subscriptions.withColumn("_p", F.when(F.col("status") == "active", 1).when(F.col("status") == "trialing", 2)
                                   .otherwise(3))
    return latest_per_key(s.select("organization_id", "subscription_id", "status", "_p", "current_period_start"),
                          ["organization_id"], [("_p", "asc"), ("current_period_start", "desc"),
                                                ("subscription_id", "desc")]) \
        .select("organization_id", "subscription_id", "status")


@q("win_trailing_distinct", """
SELECT c.d AS event_date,
       (SELECT count(DISTINCT e.user_id) FROM events e WHERE CAST(e.ts AS DATE) BETWEEN c.d - INTERVAL 6 DAY AND c.d) AS active_users_7d,
       (SELECT count(DISTINCT e.user_id) FROM events e WHERE CAST(e.ts AS DATE) BETWEEN c.d - INTERVAL 29 DAY AND c.d) AS active_users_30d
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) c""")
def win_trailing_distinct(b):
    """Trailing 7/30-day distinct users per event day (explode of deduplicated
    (user, day) pairs; no correlated range subquery)."""
    e = b.t.events.select("user_id", F.to_date("ts").alias("event_date"))
    cal = e.select("event_date").distinct()
    t = trailing_distinct_multi(e, "user_id", "event_date", {"active_users_7d": 7, "active_users_30d": 30}, cal)
    return cal.join(t, "event_date", "left")


@q("win_rolling_bounds", """SELECT d AS date_day, CAST(d - INTERVAL 6 DAY AS DATE) AS rolling_7d_start,
       CAST(d - INTERVAL 27 DAY AS DATE) AS rolling_28d_start, d AS rolling_end
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""")
def win_rolling_bounds(b):
    d = b.t.events.select(F.to_date("ts").alias("date_day")).distinct()
    return d.select("date_day", F.date_sub("date_day", 6).alias("rolling_7d_start"),
                    F.date_sub("date_day", 27).alias("rolling_28d_start"), F.col("date_day").alias("rolling_end"))


# ============================================================ sorts / limits
@q("ord_multi_key", "SELECT * FROM gtm_cohort_retention ORDER BY cohort_week ASC, weeks_since_signup ASC",
   "gtm_cohort_retention")
def ord_multi_key(b):
    from .growth import gtm_cohort_retention
    return gtm_cohort_retention(b).orderBy(F.col("cohort_week").asc(), F.col("weeks_since_signup").asc())


@q("ord_case_rank", """SELECT task_id, priority, signal_score, due_at FROM gtm_task_queue
ORDER BY CASE priority WHEN 'urgent' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, signal_score DESC, due_at ASC, task_id""",
   "gtm_task_queue")
def ord_case_rank(b):
    from .growth import gtm_task_queue
    t = gtm_task_queue(b).select("task_id", "priority", "signal_score", "due_at")
    rank = F.when(F.col("priority") == "urgent", 1).when(F.col("priority") == "high", 2).otherwise(3)
    return t.orderBy(rank, F.col("signal_score").desc(), F.col("due_at").asc(), F.col("task_id"))


@q("ord_expr", """SELECT * FROM (SELECT tie_key, tie_status, delta FROM (
  SELECT coalesce(a.k, m.k) AS tie_key,
         CASE WHEN a.k IS NULL OR m.k IS NULL OR abs(a.v - m.v) > 0.01 THEN 'mismatch' ELSE 'match' END AS tie_status,
         round(coalesce(a.v, 0) - coalesce(m.v, 0), 2) AS delta
  FROM (SELECT CAST(session_date AS VARCHAR) AS k, count(*)::DOUBLE AS v FROM fct_sessions GROUP BY 1) a
  FULL OUTER JOIN (SELECT CAST(metric_date AS VARCHAR) AS k, total_sessions::DOUBLE AS v FROM ops_daily) m ON a.k = m.k))
ORDER BY CASE WHEN tie_status = 'mismatch' THEN 0 ELSE 1 END, abs(delta) DESC, tie_key""", "fct_sessions", "ops_daily")
def ord_expr(b):
    from .product import ops_daily
    a = fct_sessions(b).groupBy(F.col("session_date").cast("string").alias("k")).agg(
        F.count(F.lit(1)).cast("double").alias("av"))
    m = ops_daily(b).select(F.col("metric_date").cast("string").alias("k2"), F.col("total_sessions").cast("double").alias("mv"))
    j = a.join(m, F.col("k") == F.col("k2"), "full")
    st = F.when(F.col("k").isNull() | F.col("k2").isNull() | (F.abs(F.col("av") - F.col("mv")) > 0.01), "mismatch") \
        .otherwise("match")
    out = j.select(F.coalesce("k", "k2").alias("tie_key"), st.alias("tie_status"),
                   F.round(F.coalesce("av", F.lit(0.0)) - F.coalesce("mv", F.lit(0.0)), 2).alias("delta"))
    return out.orderBy(F.when(F.col("tie_status") == "mismatch", 0).otherwise(1), F.abs("delta").desc(), "tie_key")


TOP_K = 25


@q("lim_top_k", f"""SELECT organization_id, count(*) AS sessions FROM b_sessions GROUP BY 1
ORDER BY sessions DESC, organization_id ASC LIMIT {TOP_K}""", "b_sessions")
def lim_top_k(b):
    """ORDER BY + LIMIT: planned as TakeOrderedAndProject (per-partition top-k, then merge)."""
    s = b.sessions.groupBy("organization_id").agg(F.count(F.lit(1)).alias("sessions"))
    return s.orderBy(F.col("sessions").desc(), F.col("organization_id").asc()).limit(TOP_K)


@q("lim_latest_row", "SELECT * FROM ops_daily ORDER BY metric_date DESC LIMIT 1", "ops_daily")
def lim_latest_row(b):
    from .product import ops_daily
    return ops_daily(b).orderBy(F.col("metric_date").desc()).limit(1)


PAGE, PAGE_SIZE = 3, 50


@q("lim_page", f"""SELECT p.*, t.total_rows FROM (
  SELECT organization_id, sum(CAST(round(realized_revenue_usd * 100) AS BIGINT)) / 100.0 AS revenue_usd FROM fin_monthly_revenue GROUP BY 1
  ORDER BY revenue_usd DESC, organization_id LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE}) p
CROSS JOIN (SELECT count(DISTINCT organization_id) AS total_rows FROM fin_monthly_revenue) t""", "fin_monthly_revenue")
def lim_page(b):
    r = fin_monthly_revenue(b)
    agg = r.groupBy("organization_id").agg(exact_sum("realized_revenue_usd", 2).alias("revenue_usd"))
    page = agg.orderBy(F.col("revenue_usd").desc(), F.col("organization_id")).offset((PAGE - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    total = r.agg(F.countDistinct("organization_id")).scalar()  # scalar subquery
    return page.withColumn("total_rows", total)


# Governed query caps (rows, payload bytes).
ROW_CAP = 500
BYTE_CAP = 1_000_000


@q("lim_row_cap", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT {ROW_CAP}")
def lim_row_cap(b):
    return b.t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(ROW_CAP)


@q("lim_byte_cap", f"""
WITH page AS (SELECT doc_id, strlen(concat_ws('|', doc_id, lang, source, text)) AS n FROM documents ORDER BY doc_id LIMIT {ROW_CAP})
SELECT x.doc_id, CAST(sum(y.n) AS BIGINT) AS cum_bytes FROM page x JOIN page y ON y.doc_id <= x.doc_id
GROUP BY x.doc_id HAVING sum(y.n) <= {BYTE_CAP}""")
def lim_byte_cap(b):
    """Rows of a capped page kept while their encoded bytes stay under the payload cap.

    The running sum runs over the row-capped page (at most ROW_CAP rows); a
    page of whole documents exceeds the byte cap.
    """
    row = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", "text")
    top = b.t.documents.select("doc_id", F.octet_length(row).cast("long").alias("_n")).orderBy("doc_id").limit(ROW_CAP)
    w = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.select("doc_id", F.sum("_n").over(w).alias("cum_bytes")).filter(F.col("cum_bytes") <= BYTE_CAP)


# ================================================================ set ops
@q("set_union_all", """SELECT 'card' AS source, count(*) AS records, CAST(sum(amount_cents) AS BIGINT) AS cents FROM b_fin_transactions
UNION ALL SELECT 'reimbursement', count(*), CAST(sum(amount_cents) AS BIGINT) FROM b_fin_reimbursements
UNION ALL SELECT 'bill_payment', count(*), CAST(sum(amount_cents) AS BIGINT) FROM b_fin_bill_payments""",
   "b_fin_transactions", "b_fin_reimbursements", "b_fin_bill_payments")
def set_union_all(b):
    parts = [(b.fin_transactions, "card"), (b.fin_reimbursements, "reimbursement"), (b.fin_bill_payments, "bill_payment")]
    out = None
    for df, tag in parts:
        a = df.agg(F.count(F.lit(1)).alias("records"), F.sum("amount_cents").alias("cents")) \
            .select(F.lit(tag).alias("source"), "records", "cents")
        out = a if out is None else out.unionByName(a)
    return out


@q("set_union_distinct", """SELECT CAST(created_at AS DATE) AS d FROM b_leads UNION
SELECT CAST(converted_at AS DATE) FROM b_leads WHERE converted_at IS NOT NULL UNION
SELECT CAST(created_at AS DATE) FROM b_opportunities""", "b_leads", "b_opportunities")
def set_union_distinct(b):
    return union_calendar((b.leads, "created_at"), (b.leads, "converted_at"), (b.opportunities, "created_at"))


@q("set_union_keys", """SELECT organization_id, CAST(date_trunc('month', started_at) AS DATE) AS m FROM b_sessions
UNION SELECT organization_id, CAST(date_trunc('month', period_start) AS DATE) FROM b_invoices""", "b_sessions", "b_invoices")
def set_union_keys(b):
    a = b.sessions.select("organization_id", month_start("started_at").alias("m"))
    c = b.invoices.select("organization_id", month_start("period_start").alias("m"))
    return a.unionByName(c).distinct()


@q("set_wide_to_long", """SELECT as_of_date, plan_name, mrr_usd FROM (
  SELECT as_of_date, 'starter' AS plan_name, starter_mrr_usd AS mrr_usd FROM fin_mrr
  UNION ALL SELECT as_of_date, 'pro', pro_mrr_usd FROM fin_mrr
  UNION ALL SELECT as_of_date, 'enterprise', enterprise_mrr_usd FROM fin_mrr)""", "fin_mrr")
def set_wide_to_long(b):
    from .finance import fin_mrr
    m = fin_mrr(b).select("as_of_date", F.col("starter_mrr_usd").alias("starter"), F.col("pro_mrr_usd").alias("pro"),
                          F.col("enterprise_mrr_usd").alias("enterprise"))
    return m.unpivot("as_of_date", ["starter", "pro", "enterprise"], "plan_name", "mrr_usd")


@q("set_difference", """
(SELECT 'sessions_only' AS side, organization_id, m FROM (
   SELECT organization_id, CAST(date_trunc('month', started_at) AS DATE) AS m FROM b_sessions
   EXCEPT SELECT organization_id, CAST(date_trunc('month', period_start) AS DATE) FROM b_invoices WHERE invoice_status = 'paid'))
UNION ALL
(SELECT 'paid_only', organization_id, m FROM (
   SELECT organization_id, CAST(date_trunc('month', period_start) AS DATE) AS m FROM b_invoices WHERE invoice_status = 'paid'
   EXCEPT SELECT organization_id, CAST(date_trunc('month', started_at) AS DATE) FROM b_sessions))""", "b_sessions", "b_invoices")
def set_difference(b):
    a = b.sessions.select("organization_id", month_start("started_at").alias("m"))
    p = b.invoices.filter(F.col("invoice_status") == "paid").select("organization_id", month_start("period_start").alias("m"))
    return (a.subtract(p).select(F.lit("sessions_only").alias("side"), "organization_id", "m")
            .unionByName(p.subtract(a).select(F.lit("paid_only").alias("side"), "organization_id", "m")))


@q("set_intersection", """
SELECT organization_id, m, count(*) FILTER (kind = 's') AS sessions, count(*) FILTER (kind = 'p') AS payments
FROM (SELECT 's' AS kind, organization_id, CAST(date_trunc('month', started_at) AS DATE) AS m FROM b_sessions
      UNION ALL SELECT 'p', organization_id, CAST(date_trunc('month', paid_at) AS DATE) FROM b_invoices WHERE paid_at IS NOT NULL)
GROUP BY 1, 2 HAVING count(DISTINCT kind) = 2 AND count(*) FILTER (kind = 's') <> count(*) FILTER (kind = 'p')""",
   "b_sessions", "b_invoices")
def set_intersection(b):
    """(organisation, month) pairs with sessions and payments whose counts differ."""
    a = b.sessions.select("organization_id", month_start("started_at").alias("m"))
    c = b.invoices.filter(F.col("paid_at").isNotNull()).select("organization_id", month_start("paid_at").alias("m"))
    k = a.intersect(c)
    s = a.groupBy("organization_id", "m").agg(F.count(F.lit(1)).alias("sessions"))
    i = c.groupBy("organization_id", "m").agg(F.count(F.lit(1)).alias("payments"))
    return k.join(s, ["organization_id", "m"]).join(i, ["organization_id", "m"]) \
        .filter(F.col("sessions") != F.col("payments"))


# ========================================================== scalar functions
@q("fn_url_domain", "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS domain FROM pages")
def fn_url_domain(b):
    return b.t.pages.select("page_id", url_domain("url").alias("domain"))


@q("fn_duration_bucket", """SELECT CASE WHEN duration_seconds IS NULL THEN 'unknown' WHEN duration_seconds < 60 THEN 'under_1_min'
            WHEN duration_seconds < 300 THEN '1_to_5_mins' WHEN duration_seconds < 900 THEN '5_to_15_mins'
            WHEN duration_seconds < 1800 THEN '15_to_30_mins' ELSE 'over_30_mins' END AS duration_bucket, count(*) AS sessions
FROM b_sessions GROUP BY 1""", "b_sessions")
def fn_duration_bucket(b):
    return b.sessions.groupBy(duration_bucket("duration_seconds").alias("duration_bucket")) \
        .agg(F.count(F.lit(1)).alias("sessions"))


@q("fn_kv_regex_extract", """SELECT activity_id,
       nullif(regexp_extract(subject, 'organization_id=([^|\\s]+)', 1), '') AS organization_id,
       nullif(regexp_extract(subject, 'action_type=([^|\\s]+)', 1), '') AS action_type,
       nullif(regexp_extract(subject, 'destination=([^|\\s]+)', 1), '') AS destination,
       nullif(regexp_extract(subject, 'error=([^|\\s]+)', 1), '') AS error
FROM b_activities""", "b_activities")
def fn_kv_regex_extract(b):
    a = b.activities
    return a.select("activity_id", *[kv_extract("subject", k).alias(k)
                                     for k in ("organization_id", "action_type", "destination", "error")])


@q("fn_composite_key", """SELECT subscription_id,
       CAST(organization_id AS VARCHAR) || '|' || coalesce(CAST(CAST(trial_ends_at AS DATE) AS VARCHAR), '') || '|' || plan_id
         AS composite_key FROM b_subscriptions""", "b_subscriptions")
def fn_composite_key(b):
    s = b.subscriptions
    return s.select("subscription_id", F.concat_ws("|", F.col("organization_id").cast("string"),
                                                   F.coalesce(F.to_date("trial_ends_at").cast("string"), F.lit("")),
                                                   F.col("plan_id")).alias("composite_key"))


@q("fn_date_parts", """SELECT session_id, CAST(year(started_at) AS INTEGER) AS y, CAST(month(started_at) AS INTEGER) AS mo,
       CAST(day(started_at) AS INTEGER) AS dd, CAST(dayofweek(started_at) AS INTEGER) AS dow, CAST(yearweek(started_at) AS INTEGER) AS iso_yearweek,
       CAST(date_trunc('quarter', started_at) AS DATE) AS quarter_start, CAST(date_trunc('week', started_at) AS DATE) AS week_start,
       strftime(started_at, '%Y%m') AS yyyymm, CAST(epoch(started_at) AS BIGINT) AS epoch_seconds
FROM b_sessions""", "b_sessions")
def fn_date_parts(b):
    s, t = b.sessions, F.col("started_at")
    from ..functions.exprs import dow_sunday0
    return s.select("session_id", F.year(t).alias("y"), F.month(t).alias("mo"), F.dayofmonth(t).alias("dd"),
                    dow_sunday0(t).alias("dow"), iso_yearweek(t).cast("int").alias("iso_yearweek"),
                    F.date_trunc("quarter", t.cast("timestamp")).cast("date").alias("quarter_start"),
                    week_start(t).alias("week_start"), F.date_format(t, "yyyyMM").alias("yyyymm"),
                    F.unix_timestamp(t.cast("timestamp")).alias("epoch_seconds"))


@q("fn_interval_days", f"""SELECT subscription_id,
       CAST(date_diff('day', CAST(current_period_start AS DATE), least(CAST(current_period_end AS DATE), {AS_OF_SQL})) AS INTEGER) AS days_active,
       CAST(least(CAST(current_period_end AS DATE), {AS_OF_SQL}) - INTERVAL 30 DAY AS DATE) AS renewal_window_start,
       round(date_diff('second', current_period_start, least(current_period_end, {AS_OF_TS_SQL})) / 86400.0, 4) AS fractional_days
FROM b_subscriptions""", "b_subscriptions")
def fn_interval_days(b):
    s = b.subscriptions
    end_d = F.least(F.to_date("current_period_end"), _d(b))
    end_ts = F.least(F.col("current_period_end"), F.lit(f"{b.as_of} 00:00:00").cast("timestamp_ntz"))
    return s.select("subscription_id", F.datediff(end_d, F.to_date("current_period_start")).alias("days_active"),
                    F.date_sub(end_d, 30).alias("renewal_window_start"),
                    F.round(F.timestamp_diff("SECOND", F.col("current_period_start"), end_ts) / 86400.0, 4)
                     .alias("fractional_days"))


@q("fn_clamp_weighted_score", """SELECT c_custkey,
       round(least(greatest(0.6 * (c_acctbal / 10000.0) + 0.4 * ((c_custkey % 10) / 10.0), 0.0), 1.0), 4) AS score
FROM customer""")
def fn_clamp_weighted_score(b):
    from ..functions.exprs import clamp
    c = b.t.customer
    return c.select("c_custkey", F.round(clamp(0.6 * (F.col("c_acctbal") / 10000.0)
                                                + 0.4 * ((F.col("c_custkey") % 10) / 10.0), 0.0, 1.0), 4).alias("score"))


@q("fn_unit_convert", """SELECT session_id, round((bytes_downloaded + bytes_uploaded) / 1024.0 / 1024.0 / 1024.0, 6) AS gb,
       round(duration_seconds / 3600.0, 6) AS hours, round(bytes_downloaded / 100.0, 2) AS usd_equivalent FROM b_sessions""",
   "b_sessions")
def fn_unit_convert(b):
    s = b.sessions
    return s.select("session_id",
                    F.round((F.col("bytes_downloaded") + F.col("bytes_uploaded")) / 1024.0 / 1024.0 / 1024.0, 6).alias("gb"),
                    F.round(F.col("duration_seconds") / 3600.0, 6).alias("hours"),
                    F.round(F.col("bytes_downloaded") / 100.0, 2).alias("usd_equivalent"))


@q("fn_hash_id", """SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS md5_key,
       substr(md5(CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)), 1, 12) AS short_id,
       sha256(CAST(o_custkey AS VARCHAR)) AS sha_key FROM orders""")
def fn_hash_id(b):
    o = b.t.orders
    return o.select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("md5_key"),
                    F.substring(F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"),
                                                  F.col("o_orderkey").cast("string"))), 1, 12).alias("short_id"),
                    F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha_key"))


@q("fn_try_cast", """SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS name_number,
       TRY_CAST(c_mktsegment AS INTEGER) AS segment_as_int FROM customer""")
def fn_try_cast(b):
    c = b.t.customer
    return c.select("c_custkey", F.substring("c_name", 10, 100).try_cast("bigint").alias("name_number"),
                    F.col("c_mktsegment").try_cast("int").alias("segment_as_int"))


@q("fn_json_field", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def fn_json_field(b):
    e = b.t.events
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@q("fn_initials", """SELECT p_partkey,
       array_to_string(list_transform(list_filter(string_split_regex(trim(p_name), '\\s+'), lambda w: length(w) > 0)[1:3],
                       lambda w: upper(substr(w, 1, 1))), '') AS initials FROM part""")
def fn_initials(b):
    p = b.t.part
    return p.select("p_partkey", initials("p_name").alias("initials"))


# ==================================================================== spines
@q("spn_date", """SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE)
       AS date_day FROM events""")
def spn_date(b):
    from ..operators.shapes import date_spine
    bounds = b.t.events.agg(F.min(F.to_date("ts")).alias("d0"), F.max(F.to_date("ts")).alias("d1"))
    return date_spine(bounds, "d0", "d1", "date_day")


@q("spn_month_distinct", f"""SELECT CAST(unnest(generate_series(CAST(date_trunc('month', min(started_at)) AS DATE),
       CAST(date_trunc('month', {AS_OF_SQL}) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM b_sessions""",
   "b_sessions")
def spn_month_distinct(b):
    from ..operators.shapes import month_series
    bounds = b.sessions.agg(F.min(F.to_date("started_at")).alias("d0"))
    return month_series(bounds, "d0", _d(b), "month_start")


@q("spn_entity_day", f"""SELECT organization_id, min(d) AS first_day, max(d) AS last_day, count(*) AS n_days FROM (
  SELECT organization_id, unnest(generate_series(CAST(created_at AS DATE), {AS_OF_SQL}, INTERVAL 1 DAY)) AS d
  FROM b_organizations WHERE CAST(created_at AS DATE) <= {AS_OF_SQL}) GROUP BY 1""", "b_organizations")
def spn_entity_day(b):
    sp = entity_day_spine(b.organizations, "organization_id", "created_at", _d(b), "d")
    return sp.groupBy("organization_id").agg(F.min("d").cast("timestamp_ntz").alias("first_day"),
                                             F.max("d").cast("timestamp_ntz").alias("last_day"),
                                             F.count(F.lit(1)).alias("n_days"))


@q("spn_entity_month", f"""SELECT organization_id, CAST(unnest(generate_series(CAST(date_trunc('month', created_at) AS DATE),
       CAST(date_trunc('month', {AS_OF_SQL}) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM b_organizations""",
   "b_organizations")
def spn_entity_month(b):
    o = b.organizations
    return o.select("organization_id", F.explode(F.sequence(F.trunc(F.to_date("created_at"), "MM"),
                                                            F.trunc(_d(b), "MM"), F.expr("INTERVAL 1 MONTH")))
                    .alias("month_start"))


@q("spn_event_calendar", """SELECT CAST(created_at AS DATE) AS d FROM b_leads UNION
SELECT CAST(converted_at AS DATE) FROM b_leads WHERE converted_at IS NOT NULL UNION
SELECT CAST(created_at AS DATE) FROM b_opportunities UNION
SELECT CAST(closed_at AS DATE) FROM b_opportunities WHERE closed_at IS NOT NULL""", "b_leads", "b_opportunities")
def spn_event_calendar(b):
    return union_calendar((b.leads, "created_at"), (b.leads, "converted_at"), (b.opportunities, "created_at"),
                          (b.opportunities, "closed_at"))


@q("spn_plan_grid", f"""
WITH months AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', {AS_OF_SQL}) - INTERVAL 11 MONTH AS DATE),
                CAST(date_trunc('month', {AS_OF_SQL}) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS metric_month),
agg AS (SELECT metric_month, primary_plan_name, count(*) AS customers,
               sum(CAST(round(total_session_hours * 1000000) AS BIGINT)) / 1000000.0 AS hours FROM fin_cue GROUP BY 1, 2)
SELECT m.metric_month, p.plan_id, coalesce(a.customers, 0) AS customers, coalesce(a.hours, 0.0) AS session_hours
FROM months m CROSS JOIN b_plans p LEFT JOIN agg a ON a.metric_month = m.metric_month AND a.primary_plan_name = p.plan_id""",
   "fin_cue", "b_plans")
def spn_plan_grid(b):
    """12-month x plan grid (bounded: 12 x catalogue), zero-filled from the customer mart."""
    from ..operators.shapes import month_series
    from .finance import fin_customer_unit_economics
    one = b.spark.range(1)
    months = month_series(one, F.add_months(F.trunc(_d(b), "MM"), -11), F.trunc(_d(b), "MM"), "metric_month")
    grid = months.crossJoin(F.broadcast(b.plans.select("plan_id")))  # 12 x 4 rows, bounded
    a = fin_customer_unit_economics(b).groupBy("metric_month", F.col("primary_plan_name").alias("plan_id")).agg(
        F.count(F.lit(1)).alias("customers"), exact_sum("total_session_hours", 6).alias("session_hours"))
    return grid.join(a, ["metric_month", "plan_id"], "left").select(
        "metric_month", "plan_id", F.coalesce("customers", F.lit(0)).alias("customers"),
        F.coalesce("session_hours", F.lit(0.0)).alias("session_hours"))


@q("spn_expand_interval", "SELECT organization_id, metric_date, subscription_mrr_usd FROM sub_daily_mrr", "sub_daily_mrr")
def spn_expand_interval(b):
    from .terminal import subscription_daily_mrr
    return subscription_daily_mrr(b)
