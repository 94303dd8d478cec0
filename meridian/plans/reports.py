"""Serving reports: filter / group / join / order / limit over the gold products.

Limits appear only where the report is a top-k or a single-period view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import clamp, count_if, exact_avg, exact_sum, pct_change, safe_ratio, week_start
from ..operators.shapes import latest_per_key
from .core import bridge_org_activity, dim_organizations, fct_sessions
from .finance import fin_customer_unit_economics, fin_monthly_revenue, fin_mrr
from .finance_ops import fin_budget_vs_actual, fin_spend_monthly, fin_vendor_spend_monthly
from .growth import (gtm_action_log, gtm_active_organizations, gtm_campaign_channel, gtm_cohort_retention,
                     gtm_funnel_daily, gtm_growth_kpis, gtm_pipeline_snapshot, gtm_task_execution, gtm_task_queue,
                     gtm_trial_risk)
from .oracle_views import AS_OF_SQL, AS_OF_TS_SQL
from .product import eng_daily, eng_kpis, ops_daily, ops_kpis, pro_product_daily, pro_sessions_daily
from .registry import register
from .terminal import core_daily_kpis, core_metric_spine, term_business_snapshot


def _d(b):
    return F.lit(b.as_of).cast("date")


def _since(col, b, days):
    return F.col(col) >= F.date_sub(_d(b), days)


def _months_back(col, b, n):
    return F.col(col) >= F.add_months(F.trunc(_d(b), "MM"), -n)


@register("rpt_exec_scorecard_30d", f"""
SELECT date, total_sessions, successful_sessions, failed_sessions, success_rate_pct, daily_active_organizations, new_organizations, new_users,
       round(total_session_minutes, 1) AS total_session_minutes, round(total_gb_transferred, 2) AS total_gb_transferred
FROM core_daily_kpis WHERE date_diff('day', date, {AS_OF_SQL}) < 30 ORDER BY date""", ("core_daily_kpis",))
def rpt_exec_scorecard_30d(b):
    """The last 30 days up to the evaluation date, oldest first."""
    return (core_daily_kpis(b).filter(_since("date", b, 29)).select(
        "date", "total_sessions", "successful_sessions", "failed_sessions", "success_rate_pct", "daily_active_organizations",
        "new_organizations", "new_users", F.round("total_session_minutes", 1).alias("total_session_minutes"),
        F.round("total_gb_transferred", 2).alias("total_gb_transferred")).orderBy("date"))


@register("rpt_mrr_trend", f"""
SELECT month_start AS as_of_date, sum(mrr_usd) AS total_mrr_usd, count(*) FILTER (mrr_usd > 0) AS total_paying_customers,
       round(sum(mrr_usd) / nullif(count(*) FILTER (mrr_usd > 0), 0), 2) AS arpu_usd
FROM term_business_snapshot WHERE date_diff('month', month_start, {AS_OF_SQL}) <= 12 GROUP BY 1 ORDER BY 1""",
          ("term_business_snapshot",))
def rpt_mrr_trend(b):
    """Monthly MRR, paying customers and ARPU over the last 12 months."""
    s = term_business_snapshot(b).filter(_months_back("month_start", b, 12))
    g = s.groupBy(F.col("month_start").alias("as_of_date")).agg(
        exact_sum("mrr_usd", 2).alias("total_mrr_usd"), count_if(F.col("mrr_usd") > 0).alias("total_paying_customers"))
    return g.withColumn("arpu_usd", safe_ratio("total_mrr_usd", "total_paying_customers", 1.0)).orderBy("as_of_date")


@register("rpt_plan_mix", """
SELECT unnest(['starter', 'pro', 'enterprise']) AS plan, unnest([starter_mrr_usd, pro_mrr_usd, enterprise_mrr_usd]) AS mrr_usd,
       unnest([starter_customers, pro_customers, enterprise_customers]) AS customers
FROM (SELECT * FROM fin_mrr ORDER BY as_of_date DESC LIMIT 1) ORDER BY mrr_usd DESC""", ("fin_mrr",))
def rpt_plan_mix(b):
    """Revenue and customers by plan in the latest snapshot."""
    m = fin_mrr(b).orderBy(F.col("as_of_date").desc()).limit(1)
    rows = F.array(*[F.struct(F.lit(p).alias("plan"), F.col(f"{p}_mrr_usd").alias("mrr_usd"), F.col(f"{p}_customers").alias("customers"))
                     for p in ("starter", "pro", "enterprise")])
    return m.select(F.inline(rows)).orderBy(F.col("mrr_usd").desc())


@register("rpt_cohort_matrix", """SELECT * FROM gtm_cohort_retention
WHERE cohort_week >= (SELECT max(cohort_week) FROM gtm_cohort_retention) - INTERVAL 180 DAY
ORDER BY cohort_week, weeks_since_signup""", ("gtm_cohort_retention",))
def rpt_cohort_matrix(b):
    """Retention matrix of the cohorts from the 180 days before the latest cohort."""
    c = gtm_cohort_retention(b)
    start = c.agg(F.date_sub(F.max("cohort_week"), 180)).scalar()  # scalar subquery
    return c.filter(F.col("cohort_week") >= start).orderBy("cohort_week", "weeks_since_signup")


@register("rpt_signup_funnel", """
WITH joined AS (
  SELECT CAST(date_trunc('week', organization_created_at) AS DATE) AS signup_week, is_paying_customer AS pays,
         organization_id IN (SELECT s.organization_id FROM fct_sessions s
                             WHERE s.started_at <= o.organization_created_at + INTERVAL 7 DAY) AS quick
  FROM dim_organizations o WHERE organization_created_at >= (SELECT max(CAST(organization_created_at AS DATE)) FROM dim_organizations) - INTERVAL 180 DAY)
SELECT signup_week, count(*) AS signups, count(*) FILTER (quick) AS activated_7d, count(*) FILTER (pays) AS paying_orgs,
       round(100.0::DOUBLE * count(*) FILTER (quick) / count(*), 2) AS activation_rate_7d_pct,
       round(100.0::DOUBLE * count(*) FILTER (pays) / count(*), 2) AS paid_rate_pct
FROM joined GROUP BY 1 ORDER BY 1 DESC""", ("dim_organizations", "fct_sessions"))
def rpt_signup_funnel(b):
    """Sign-ups of the 180 days up to the latest one by week, with activation in the first 7 days and payment."""
    first = fct_sessions(b).groupBy("organization_id").agg(F.min("started_at").alias("first_session_at"))
    orgs = dim_organizations(b)
    since = orgs.agg(F.date_sub(F.max(F.to_date("organization_created_at")), 180).cast("timestamp_ntz")).scalar()
    o = orgs.filter(F.col("organization_created_at") >= since).join(first, "organization_id", "left")
    act = F.col("first_session_at") <= F.col("organization_created_at") + F.expr("INTERVAL 7 DAYS")
    g = o.groupBy(week_start("organization_created_at").alias("signup_week")).agg(
        F.count(F.lit(1)).alias("signups"), F.count_if(act).alias("activated_7d"),
        F.count_if(F.col("is_paying_customer")).alias("paying_orgs"))
    return g.select("*", safe_ratio("activated_7d", "signups").alias("activation_rate_7d_pct"),
                    safe_ratio("paying_orgs", "signups").alias("paid_rate_pct")).orderBy(F.col("signup_week").desc())


@register("rpt_top_orgs", """
SELECT organization_id, organization_name, current_plan_name, is_paying_customer, sessions_last_30d, lifetime_sessions, activity_tier, last_session_date
FROM gtm_active_organizations ORDER BY sessions_last_30d DESC, organization_id LIMIT 25""", ("gtm_active_organizations",))
def rpt_top_orgs(b):
    cols = ("organization_id", "organization_name", "current_plan_name", "is_paying_customer", "sessions_last_30d",
            "lifetime_sessions", "activity_tier", "last_session_date")
    return gtm_active_organizations(b).select(*cols).orderBy(F.col("sessions_last_30d").desc(), "organization_id").limit(25)


@register("rpt_workflow_qa", """
WITH done AS (SELECT task_id, signal_id, status FROM gtm_action_log UNION ALL SELECT task_id, signal_id, status FROM gtm_task_execution),
t AS (SELECT *, (task_id, signal_id) NOT IN (SELECT task_id, signal_id FROM done) AS idle FROM gtm_task_queue),
n AS (SELECT count(*) AS k, count(*) FILTER (status = 'success') AS good, count(*) FILTER (status = 'failed') AS bad FROM done)
SELECT count(*) AS queued_tasks, count(DISTINCT signal_id) AS queued_signals,
       round(CAST(sum(CAST(round(signal_score * 10000) AS BIGINT)) / 10000.0 / nullif(count(*), 0) AS DOUBLE), 4) AS avg_signal_score,
       any_value(n.k) AS actions_logged, any_value(n.good) AS actions_success, any_value(n.bad) AS actions_failed,
       count(*) FILTER (idle) AS queue_without_action,
       round(100.0::DOUBLE * any_value(n.good) / nullif(any_value(n.k), 0), 2) AS action_success_rate_pct,
       round(100.0::DOUBLE * count(*) FILTER (NOT idle) / nullif(count(*), 0), 2) AS queue_action_coverage_pct
FROM t, n""", ("gtm_task_queue", "gtm_action_log", "gtm_task_execution"))
def rpt_workflow_qa(b):
    """Coverage counts tasks that have an action of their own task and signal."""
    t = gtm_task_queue(b).select("task_id", "signal_id", "signal_score")
    pick = ["task_id", "signal_id", "status"]
    done = gtm_action_log(b).select(pick).unionByName(gtm_task_execution(b).select(pick))
    idle = t.join(done, ["task_id", "signal_id"], "left_anti").agg(F.count(F.lit(1))).scalar()
    a = done.agg(F.count(F.lit(1)).alias("actions_logged"), count_if(F.col("status") == "success").alias("actions_success"),
                 count_if(F.col("status") == "failed").alias("actions_failed"))
    q = t.agg(F.count(F.lit(1)).alias("queued_tasks"), F.countDistinct("signal_id").alias("queued_signals"),
              F.round(exact_avg("signal_score", 4), 4).alias("avg_signal_score"))
    names = ["actions_logged", "actions_success", "actions_failed"]
    j = q.select("*", *[a.select(c).scalar().alias(c) for c in names], idle.alias("queue_without_action"))
    return j.select("*", safe_ratio("actions_success", "actions_logged").alias("action_success_rate_pct"),
                    safe_ratio(F.col("queued_tasks") - F.col("queue_without_action"), "queued_tasks")
                    .alias("queue_action_coverage_pct"))


@register("rpt_at_risk_paying", """
SELECT organization_id, organization_name, current_plan_name, current_plan_price_usd, idle AS days_since_last_session,
       CAST(current_period_end AS DATE) AS renewal_date, runs AS lifetime_sessions
FROM dim_organizations JOIN (SELECT organization_id, days_since_last_session AS idle, total_sessions AS runs FROM bridge_org_activity)
  USING (organization_id)
WHERE is_paying_customer AND idle > 13
ORDER BY idle DESC, current_plan_price_usd DESC, organization_id LIMIT 100""", ("dim_organizations", "bridge_org_activity"))
def rpt_at_risk_paying(b):
    """The 100 paying organisations that have been idle longest, two weeks at least."""
    o = dim_organizations(b).filter(F.col("is_paying_customer"))
    a = bridge_org_activity(b).filter(F.col("days_since_last_session") >= 14)
    return (o.join(a, "organization_id").select(
        "organization_id", "organization_name", "current_plan_name", "current_plan_price_usd", "days_since_last_session",
        F.to_date("current_period_end").alias("renewal_date"), F.col("total_sessions").alias("lifetime_sessions"))
        .orderBy(F.col("days_since_last_session").desc(), F.col("current_plan_price_usd").desc(), "organization_id").limit(100))


@register("rpt_reliability_30d", f"""
SELECT metric_date, total_sessions, success_rate_pct, failure_rate_pct, timeout_rate_pct, round(errors_per_1k_sessions, 2) AS errors_per_1k_sessions,
       round(p95_duration_seconds, 1) AS p95_duration_seconds
FROM eng_daily WHERE date_diff('day', metric_date, {AS_OF_SQL}) < 30 ORDER BY metric_date""", ("eng_daily",))
def rpt_reliability_30d(b):
    return (eng_daily(b).filter(_since("metric_date", b, 29)).select(
        "metric_date", "total_sessions", "success_rate_pct", "failure_rate_pct", "timeout_rate_pct",
        F.round("errors_per_1k_sessions", 2).alias("errors_per_1k_sessions"),
        F.round("p95_duration_seconds", 1).alias("p95_duration_seconds")).orderBy("metric_date"))


@register("rpt_adoption_90d", f"""
SELECT metric_date, total_sessions, proxy_adoption_pct, stealth_adoption_pct, success_rate_pct, unique_domains_visited
FROM pro_product_daily WHERE date_diff('day', metric_date, {AS_OF_SQL}) <= 90 ORDER BY metric_date""", ("pro_product_daily",))
def rpt_adoption_90d(b):
    return (pro_product_daily(b).filter(_since("metric_date", b, 90)).select(
        "metric_date", "total_sessions", "proxy_adoption_pct", "stealth_adoption_pct", "success_rate_pct", "unique_domains_visited")
        .orderBy("metric_date"))


@register("rpt_collection", f"""
SELECT revenue_month, list_sum(list(CAST(round(realized_revenue_usd * 100) AS BIGINT))) / 100.0 AS realized_revenue_usd,
       list_sum(list(CAST(round(pending_revenue_usd * 100) AS BIGINT))) / 100.0 AS pending_revenue_usd,
       list_sum(list(CAST(round(gross_revenue_usd * 100) AS BIGINT))) / 100.0 AS gross_revenue_usd,
       round(list_sum(list(CAST(round(collection_rate_pct * 100) AS BIGINT))) / 100.0 / nullif(count(collection_rate_pct), 0), 2) AS avg_collection_rate_pct,
       CAST(sum(paid_invoice_count) AS BIGINT) AS paid_invoices, CAST(sum(open_invoice_count) AS BIGINT) AS open_invoices
FROM fin_monthly_revenue WHERE date_diff('month', revenue_month, {AS_OF_SQL}) <= 12 GROUP BY 1 ORDER BY 1""", ("fin_monthly_revenue",))
def rpt_collection(b):
    """Monthly revenue and the mean of the organisations' collection rates."""
    money = [exact_sum(f"{c}_revenue_usd", 2).alias(f"{c}_revenue_usd") for c in ("realized", "pending", "gross")]
    return (fin_monthly_revenue(b).filter(_months_back("revenue_month", b, 12)).groupBy("revenue_month").agg(
        *money, F.round(exact_avg("collection_rate_pct", 2), 2).alias("avg_collection_rate_pct"),
        F.sum("paid_invoice_count").alias("paid_invoices"), F.sum("open_invoice_count").alias("open_invoices")).orderBy("revenue_month"))


@register("rpt_budget_6m", f"""
WITH cents AS (SELECT budget_month, CAST(round(budget_allocated_usd * 100) AS BIGINT) AS p, CAST(round(actual_spend_usd * 100) AS BIGINT) AS s,
                      CAST(round(ap_open_usd * 100) AS BIGINT) AS o FROM fin_budget_vs_actual
               WHERE date_diff('month', budget_month, {AS_OF_SQL}) <= 6)
SELECT budget_month, sum(p) / 100.0 AS budget_allocated_usd, sum(s) / 100.0 AS actual_spend_usd, sum(p - s) / 100.0 AS budget_variance_usd,
       round(100.0::DOUBLE * sum(s) / nullif(sum(p), 0), 2) AS budget_utilization_ratio, sum(o) / 100.0 AS ap_open_usd
FROM cents GROUP BY 1 ORDER BY 1 DESC""", ("fin_budget_vs_actual",))
def rpt_budget_6m(b):
    names = ("budget_allocated_usd", "actual_spend_usd", "budget_variance_usd", "ap_open_usd")
    g = fin_budget_vs_actual(b).filter(_months_back("budget_month", b, 6)).groupBy("budget_month").agg(
        *[exact_sum(c, 2).alias(c) for c in names])
    return g.withColumn("budget_utilization_ratio", safe_ratio("actual_spend_usd", "budget_allocated_usd")).orderBy(
        F.col("budget_month").desc())


@register("rpt_ops_kpis", """SELECT * REPLACE (round(total_gb_transferred_30d, 2) AS total_gb_transferred_30d) FROM ops_kpis
ORDER BY as_of_date DESC LIMIT 90""", ("ops_kpis",))
def rpt_ops_kpis(b):
    """The 30-day operations figures, newest snapshot first."""
    k = ops_kpis(b).withColumn("total_gb_transferred_30d", F.round("total_gb_transferred_30d", 2))
    return k.orderBy(F.col("as_of_date").desc()).limit(90)


@register("rpt_wow_compare", f"""
WITH weeks AS (
  SELECT (date_diff('day', metric_date, {AS_OF_SQL}) > 6)::INT AS before, CAST(sum(total_sessions) AS BIGINT) AS n,
         CAST(sum(successful_sessions) AS BIGINT) AS good, CAST(sum(failed_sessions) AS BIGINT) AS bad, round(avg(active_orgs), 0) AS orgs,
         round(sum(CAST(round(avg_duration_seconds * 100) AS BIGINT)) / 100.0 / nullif(count(avg_duration_seconds), 0), 2) AS dur,
         round(sum(CAST(round(proxy_adoption_pct * 100) AS BIGINT)) / 100.0 / nullif(count(proxy_adoption_pct), 0), 2) AS proxy
  FROM pro_product_daily WHERE date_diff('day', metric_date, {AS_OF_SQL}) <= 13 GROUP BY 1)
SELECT any_value(n) FILTER (before = 0) AS sessions_7d, any_value(n) FILTER (before = 1) AS sessions_prev_7d,
       round(100.0::DOUBLE * any_value(good) FILTER (before = 0) / nullif(any_value(n) FILTER (before = 0), 0), 2) AS success_rate_7d,
       round(100.0::DOUBLE * any_value(good) FILTER (before = 1) / nullif(any_value(n) FILTER (before = 1), 0), 2) AS success_rate_prev_7d,
       any_value(bad) FILTER (before = 0) AS failed_runs_7d, any_value(bad) FILTER (before = 1) AS failed_runs_prev_7d,
       any_value(orgs) FILTER (before = 0) AS active_orgs_7d, any_value(orgs) FILTER (before = 1) AS active_orgs_prev_7d,
       any_value(dur) FILTER (before = 0) AS avg_duration_7d, any_value(dur) FILTER (before = 1) AS avg_duration_prev_7d,
       any_value(proxy) FILTER (before = 0) AS proxy_adoption_7d, any_value(proxy) FILTER (before = 1) AS proxy_adoption_prev_7d
FROM weeks""", ("pro_product_daily",))
def rpt_wow_compare(b):
    """The last seven days of the product figures beside the seven before."""
    d = pro_product_daily(b).filter(_since("metric_date", b, 13))
    aggs = []
    for name, here in (("", _since("metric_date", b, 6)), ("_prev", ~_since("metric_date", b, 6))):
        of = lambda c, here=here: F.when(here, F.col(c))
        aggs += [F.sum(of("total_sessions")).alias(f"sessions{name}_7d"), F.sum(of("successful_sessions")).alias(f"_ok{name}"),
                 F.sum(of("failed_sessions")).alias(f"failed_runs{name}_7d"), F.round(F.avg(of("active_orgs")), 0).alias(f"active_orgs{name}_7d"),
                 F.round(exact_avg(of("avg_duration_seconds"), 2), 2).alias(f"avg_duration{name}_7d"),
                 F.round(exact_avg(of("proxy_adoption_pct"), 2), 2).alias(f"proxy_adoption{name}_7d")]
    j = d.agg(*aggs)
    rates = [safe_ratio(f"_ok{name}", f"sessions{name}_7d").alias(f"success_rate{name}_7d") for name in ("", "_prev")]
    return j.select(*[c for c in j.columns if not c.startswith("_ok")], *rates)


# Session statuses by the team that looks into them, and what to do about a status.
FAILURE_TEAMS = (("platform", ("timeout", "network_error", "capacity_exceeded")),
                 ("automation", ("failed", "selector_error", "interaction_error", "navigation_error")))
FAILURE_ACTIONS = (("timeout", "Tighten timeout defaults and improve retry backoff."),
                   ("failed", "Investigate top failing selectors and fallback strategies."),
                   ("running", "Audit stuck executions and queue handoff guards."))
FAILURE_ELSE = ("orchestration", "Inspect traces and route to owning team.")


@register("rpt_failure_modes", f"""
WITH team(owner, known) AS (VALUES {", ".join(f"('{o}', {list(k)})" for o, k in FAILURE_TEAMS)}),
advice(of, recommended_action) AS (VALUES {", ".join(f"('{k}', '{a}')" for k, a in FAILURE_ACTIONS)}),
lost AS (SELECT ifnull(session_status, 'unknown') AS failure_type, lower(ifnull(session_status, '')) AS st, organization_id, project_id, duration_seconds
         FROM fct_sessions WHERE started_at + INTERVAL 14 DAY >= {AS_OF_TS_SQL}
           AND NOT (ifnull(is_successful, FALSE) AND lower(ifnull(session_status, '')) NOT IN ('failed', 'timeout', 'error')))
SELECT coalesce((SELECT any_value(owner) FROM team WHERE list_contains(known, st)), '{FAILURE_ELSE[0]}') AS owner, failure_type,
       count(*) AS failed_runs, count(DISTINCT organization_id) AS affected_orgs, count(DISTINCT project_id) AS affected_projects,
       round(avg(duration_seconds), 1) AS avg_duration_seconds,
       round(count(*) + 0.35::DOUBLE * count(*) * count(DISTINCT organization_id), 1) AS impact_score,
       coalesce((SELECT any_value(recommended_action) FROM advice WHERE advice.of = st), '{FAILURE_ELSE[1]}') AS recommended_action
FROM lost GROUP BY failure_type, st ORDER BY impact_score DESC, failed_runs DESC, failure_type LIMIT 12""", ("fct_sessions",))
def rpt_failure_modes(b):
    """Failed runs of the last 14 days by status, ranked by their impact."""
    st = F.lower(F.coalesce("session_status", F.lit("")))
    since = F.lit(f"{b.as_of} 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS")
    s = fct_sessions(b).filter((F.col("started_at") >= since)
                               & (~F.coalesce("is_successful", F.lit(False)) | st.isin("failed", "timeout", "error")))
    owner, action = F.lit(FAILURE_ELSE[0]), F.lit(FAILURE_ELSE[1])
    for team, known in FAILURE_TEAMS:
        owner = F.when(st.isin(*known), team).otherwise(owner)
    for known, text in FAILURE_ACTIONS:
        action = F.when(st == known, text).otherwise(action)
    g = s.groupBy(owner.alias("owner"), F.coalesce("session_status", F.lit("unknown")).alias("failure_type"),
                  action.alias("recommended_action")).agg(
        F.count(F.lit(1)).alias("failed_runs"), F.countDistinct("organization_id").alias("affected_orgs"),
        F.countDistinct("project_id").alias("affected_projects"), F.round(F.avg("duration_seconds"), 1).alias("avg_duration_seconds"))
    impact = F.round(F.col("failed_runs") * (1 + 0.35 * F.col("affected_orgs")), 1)
    return g.withColumn("impact_score", impact).orderBy(F.col("impact_score").desc(), F.col("failed_runs").desc(),
                                                        "failure_type").limit(12)


# What to do by reason, and the channel by lowest score.
TRIAGE_ACTIONS = {"no_recent_usage": "Run onboarding rescue sequence", "no_successful_runs": "Run onboarding rescue sequence",
                  "low_success_rate": "Schedule technical success review", "trial_ending_soon": "Exec close plan + pricing call"}
TRIAGE_ELSE = "Manual growth triage"
TRIAGE_CHANNELS = ((0.9, "call"), (0.8, "email_then_call"))


@register("rpt_task_triage", f"""
SELECT task_id, organization_name, priority, signal_score, reason_code, due_at,
       ifnull(map_from_entries({list(TRIAGE_ACTIONS.items())})[reason_code], '{TRIAGE_ELSE}') AS recommended_action,
       ['email', 'email_then_call', 'call'][1 + (signal_score >= 0.8)::INT + (signal_score >= 0.9)::INT] AS recommended_channel
FROM gtm_task_queue WHERE task_status = 'pending'
ORDER BY list_position(['urgent', 'high'], priority) NULLS LAST, signal_score DESC, due_at, task_id LIMIT 50""", ("gtm_task_queue",))
def rpt_task_triage(b):
    """The 50 pending tasks to look at first."""
    act, channel = F.lit(TRIAGE_ELSE), F.lit("email")
    for reason, text in TRIAGE_ACTIONS.items():
        act = F.when(F.col("reason_code") == reason, text).otherwise(act)
    for least, how in reversed(TRIAGE_CHANNELS):
        channel = F.when(F.col("signal_score") >= least, how).otherwise(channel)
    rank = F.when(F.col("priority") == "urgent", 1).when(F.col("priority") == "high", 2).otherwise(3)
    return (gtm_task_queue(b).filter(F.col("task_status") == "pending")
            .orderBy(rank, F.col("signal_score").desc(), "due_at", "task_id").limit(50)
            .select("task_id", "organization_name", "priority", "signal_score", "reason_code", "due_at",
                    act.alias("recommended_action"), channel.alias("recommended_channel")))


@register("rpt_action_summary_7d", f"""SELECT action_type, status, count(*) AS actions FROM (
  SELECT action_type, status, executed_at FROM gtm_action_log UNION ALL SELECT action_type, status, executed_at FROM gtm_task_execution)
WHERE executed_at >= {AS_OF_TS_SQL} - INTERVAL 7 DAY GROUP BY 1, 2""", ("gtm_action_log", "gtm_task_execution"))
def rpt_action_summary_7d(b):
    cols = ["action_type", "status", "executed_at"]
    u = gtm_action_log(b).select(cols).unionByName(gtm_task_execution(b).select(cols))
    since = F.lit(f"{b.as_of} 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return u.filter(F.col("executed_at") >= since).groupBy("action_type", "status").agg(F.count(F.lit(1)).alias("actions"))


@register("rpt_spend_by_source", f"""
SELECT spend_month, spend_source, sum(CAST(round(spend_usd * 100) AS BIGINT)) / 100.0 AS total_spend_usd
FROM fin_spend_monthly WHERE date_diff('month', spend_month, {AS_OF_SQL}) <= 1 GROUP BY ALL
ORDER BY total_spend_usd DESC, spend_month, spend_source LIMIT 25""", ("fin_spend_monthly",))
def rpt_spend_by_source(b):
    """Spend of this and the last month by source, largest first."""
    s = fin_spend_monthly(b).filter(_months_back("spend_month", b, 1)).groupBy("spend_month", "spend_source").agg(
        exact_sum("spend_usd", 2).alias("total_spend_usd"))
    return s.orderBy(F.col("total_spend_usd").desc(), "spend_month", "spend_source").limit(25)


@register("rpt_vendor_top", f"""
SELECT vendor_name, sum(CAST(round(total_spend_usd * 100) AS BIGINT)) / 100.0 AS total_spend_usd, count(DISTINCT organization_id) AS organization_count
FROM fin_vendor_spend_monthly WHERE date_diff('month', spend_month, {AS_OF_SQL}) <= 1 GROUP BY ALL
ORDER BY total_spend_usd DESC, vendor_name LIMIT 25""", ("fin_vendor_spend_monthly",))
def rpt_vendor_top(b):
    """The 25 vendors with most spend in this and the last month."""
    v = fin_vendor_spend_monthly(b).filter(_months_back("spend_month", b, 1)).groupBy("vendor_name").agg(
        exact_sum("total_spend_usd", 2).alias("total_spend_usd"), F.countDistinct("organization_id").alias("organization_count"))
    return v.orderBy(F.col("total_spend_usd").desc(), "vendor_name").limit(25)


@register("rpt_month_trend", f"""SELECT month_start, sum(CAST(round(recognized_revenue_usd * 100) AS BIGINT)) / 100.0 AS revenue_usd,
       sum(CAST(round(total_spend_usd * 100) AS BIGINT)) / 100.0 AS spend_usd, CAST(sum(total_runs) AS BIGINT) AS runs,
       CAST(sum(new_leads) AS BIGINT) AS leads
FROM term_business_snapshot WHERE month_start >= CAST(date_trunc('month', {AS_OF_SQL}) - INTERVAL 12 MONTH AS DATE) GROUP BY 1""",
          ("term_business_snapshot",))
def rpt_month_trend(b):
    s = term_business_snapshot(b).filter(_months_back("month_start", b, 12))
    return s.groupBy("month_start").agg(exact_sum("recognized_revenue_usd", 2).alias("revenue_usd"),
                                        exact_sum("total_spend_usd", 2).alias("spend_usd"),
                                        F.sum("total_runs").alias("runs"), F.sum("new_leads").alias("leads"))


@register("rpt_month_summary", f"""SELECT month_start, count(*) AS organizations,
       count(CASE WHEN total_runs > 0 THEN 1 END) AS active_organizations,
       sum(CAST(round(recognized_revenue_usd * 100) AS BIGINT)) / 100.0 AS revenue_usd, CAST(sum(total_runs) AS BIGINT) AS runs
FROM term_business_snapshot WHERE month_start = CAST(date_trunc('month', {AS_OF_SQL}) - INTERVAL 1 MONTH AS DATE) GROUP BY 1""",
          ("term_business_snapshot",))
def rpt_month_summary(b):
    s = term_business_snapshot(b).filter(F.col("month_start") == F.add_months(F.trunc(_d(b), "MM"), -1))
    return s.groupBy("month_start").agg(F.count(F.lit(1)).alias("organizations"),
                                        count_if(F.col("total_runs") > 0).alias("active_organizations"),
                                        exact_sum("recognized_revenue_usd", 2).alias("revenue_usd"),
                                        F.sum("total_runs").alias("runs"))


@register("rpt_month_leaderboard", f"""SELECT organization_id, organization_name, recognized_revenue_usd, total_runs
FROM term_business_snapshot WHERE month_start = CAST(date_trunc('month', {AS_OF_SQL}) - INTERVAL 1 MONTH AS DATE)
ORDER BY recognized_revenue_usd DESC, organization_id LIMIT 80""", ("term_business_snapshot",))
def rpt_month_leaderboard(b):
    s = term_business_snapshot(b).filter(F.col("month_start") == F.add_months(F.trunc(_d(b), "MM"), -1))
    return (s.select("organization_id", "organization_name", "recognized_revenue_usd", "total_runs")
            .orderBy(F.col("recognized_revenue_usd").desc(), "organization_id").limit(80))


@register("rpt_channel_efficiency", """SELECT metric_month, channel, count(DISTINCT campaign_id) AS campaigns,
       sum(CAST(round(won_revenue_usd * 100) AS BIGINT)) / 100.0 AS revenue_usd,
       round(sum(CAST(round(campaign_roas * 10000) AS BIGINT)) / 10000.0 / nullif(count(campaign_roas), 0), 4) AS avg_roas
FROM gtm_campaign_channel GROUP BY 1, 2""", ("gtm_campaign_channel",))
def rpt_channel_efficiency(b):
    c = gtm_campaign_channel(b)
    return c.groupBy("metric_month", "channel").agg(
        F.countDistinct("campaign_id").alias("campaigns"), exact_sum("won_revenue_usd", 2).alias("revenue_usd"),
        F.round(exact_avg("campaign_roas", 4), 4).alias("avg_roas"))


@register("rpt_roas_backout", """SELECT metric_month, campaign_id, channel, owner_employee_id, won_revenue_usd, campaign_roas,
       round(won_revenue_usd / nullif(campaign_roas, 0), 2) AS implied_spend_usd FROM gtm_campaign_channel""",
          ("gtm_campaign_channel",))
def rpt_roas_backout(b):
    c = gtm_campaign_channel(b)
    return c.select("metric_month", "campaign_id", "channel", "owner_employee_id", "won_revenue_usd", "campaign_roas",
                    F.round(F.col("won_revenue_usd") / F.nullif(F.col("campaign_roas"), F.lit(0.0)), 2)
                    .alias("implied_spend_usd"))


@register("rpt_platform_daily", """SELECT session_date, CAST(sum(total_sessions) AS BIGINT) AS sessions,
       CAST(sum(successful_sessions) AS BIGINT) AS successful, count(*) AS active_orgs,
       round(sum(successful_sessions)::DOUBLE / nullif(sum(total_sessions), 0) * 100, 2) AS success_rate_pct,
       CAST(sum(total_errors) AS BIGINT) AS errors FROM pro_sessions_daily GROUP BY 1""", ("pro_sessions_daily",))
def rpt_platform_daily(b):
    d = pro_sessions_daily(b).groupBy("session_date").agg(
        F.sum("total_sessions").alias("sessions"), F.sum("successful_sessions").alias("successful"),
        F.count(F.lit(1)).alias("active_orgs"), F.sum("total_errors").alias("errors"))
    return d.select("session_date", "sessions", "successful", "active_orgs",
                    safe_ratio("successful", "sessions").alias("success_rate_pct"), "errors")


@register("rpt_org_projects_30d", f"""SELECT organization_id, project_id, count(*) AS sessions,
       round(count(CASE WHEN is_successful THEN 1 END)::DOUBLE / count(*) * 100, 2) AS success_pct, max(started_at) AS last_seen_at
FROM fct_sessions WHERE session_date >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY 1, 2""", ("fct_sessions",))
def rpt_org_projects_30d(b):
    s = fct_sessions(b).filter(_since("session_date", b, 30))
    g = s.groupBy("organization_id", "project_id").agg(F.count(F.lit(1)).alias("sessions"),
                                                       count_if(F.col("is_successful")).alias("_ok"),
                                                       F.max("started_at").alias("last_seen_at"))
    return g.select("organization_id", "project_id", "sessions", safe_ratio("_ok", "sessions").alias("success_pct"),
                    "last_seen_at")


@register("rpt_org_history", """
WITH top AS (SELECT organization_id FROM fin_monthly_revenue GROUP BY 1
             ORDER BY sum(CAST(round(realized_revenue_usd * 100) AS BIGINT)) DESC, organization_id LIMIT 1)
SELECT 'revenue' AS record_type, r.organization_id, CAST(r.revenue_month AS TIMESTAMP) AS recorded_at,
       r.realized_revenue_usd AS value FROM fin_monthly_revenue r JOIN top USING (organization_id)
UNION ALL SELECT 'risk', s.organization_id, s.triggered_at, s.signal_score FROM gtm_trial_risk s JOIN top USING (organization_id)
UNION ALL SELECT 'task', q.organization_id, q.created_at, q.signal_score FROM gtm_task_queue q JOIN top USING (organization_id)
ORDER BY recorded_at DESC""", ("fin_monthly_revenue", "gtm_trial_risk", "gtm_task_queue"))
def rpt_org_history(b):
    """History of the top-revenue organisation (the drill-down target), newest first."""
    r = fin_monthly_revenue(b)
    top = (r.groupBy("organization_id").agg(F.sum(F.round(F.col("realized_revenue_usd") * 100).cast("long")).alias("_c"))
           .orderBy(F.col("_c").desc(), "organization_id").limit(1).select("organization_id"))
    rev = r.join(top, "organization_id").select(F.lit("revenue").alias("record_type"), "organization_id",
                                                F.col("revenue_month").cast("timestamp_ntz").alias("recorded_at"),
                                                F.col("realized_revenue_usd").alias("value"))
    risk = gtm_trial_risk(b).join(top, "organization_id").select(
        F.lit("risk").alias("record_type"), "organization_id", F.col("triggered_at").alias("recorded_at"),
        F.col("signal_score").alias("value"))
    task = gtm_task_queue(b).join(top, "organization_id").select(
        F.lit("task").alias("record_type"), "organization_id", F.col("created_at").alias("recorded_at"),
        F.col("signal_score").alias("value"))
    return rev.unionByName(risk).unionByName(task).orderBy(F.col("recorded_at").desc())


@register("rpt_customer_typeahead", """
SELECT organization_id, max(organization_name) AS organization_name, ifnull(max(primary_plan_name), 'unknown') AS plan_name
FROM fin_cue WHERE metric_month = (SELECT max(metric_month) FROM fin_cue) GROUP BY 1
ORDER BY max(total_session_hours) DESC, organization_id LIMIT 200""", ("fin_cue",))
def rpt_customer_typeahead(b):
    """The 200 customers with most session hours in the latest month."""
    c = fin_customer_unit_economics(b)
    latest = c.agg(F.max("metric_month")).scalar()  # scalar subquery
    g = c.filter(F.col("metric_month") == latest).groupBy("organization_id").agg(
        F.max("organization_name").alias("organization_name"), F.max("primary_plan_name").alias("_plan"),
        F.max("total_session_hours").alias("_hours"))
    return (g.orderBy(F.col("_hours").desc(), "organization_id").limit(200)
            .select("organization_id", "organization_name", F.coalesce("_plan", F.lit("unknown")).alias("plan_name")))


@register("rpt_plan_activity", """SELECT coalesce(current_plan_name, 'none') AS plan, activity_tier, count(*) AS orgs,
       CAST(sum(sessions_last_30d) AS BIGINT) AS sessions FROM gtm_active_organizations GROUP BY 1, 2""",
          ("gtm_active_organizations",))
def rpt_plan_activity(b):
    a = gtm_active_organizations(b)
    return a.groupBy(F.coalesce("current_plan_name", F.lit("none")).alias("plan"), "activity_tier").agg(
        F.count(F.lit(1)).alias("orgs"), F.sum("sessions_last_30d").alias("sessions"))


@register("rpt_spine_daily", """SELECT metric_date, CAST(sum(session_count) AS BIGINT) AS sessions,
       CAST(sum(is_active_org) AS BIGINT) AS active_orgs, count(*) AS orgs_in_spine,
       sum(subscription_mrr_usd) AS mrr_usd FROM core_metric_spine GROUP BY 1""", ("core_metric_spine",))
def rpt_spine_daily(b):
    s = core_metric_spine(b)
    return s.groupBy("metric_date").agg(F.sum("session_count").alias("sessions"), F.sum("is_active_org").alias("active_orgs"),
                                        F.count(F.lit(1)).alias("orgs_in_spine"),
                                        exact_sum("subscription_mrr_usd", 2).alias("mrr_usd"))


def _finance_rows(b, most: int):
    """The newest organisation-months by realised revenue, as the boards read them."""
    return (fin_monthly_revenue(b).orderBy(F.col("revenue_month").desc(), F.col("realized_revenue_usd").desc(), "organization_id").limit(most)
            .select("organization_id", "revenue_month", "organization_name", "realized_revenue_usd", "pending_revenue_usd", "collection_rate_pct"))


def _latest_risk(b):
    cols = ["organization_id", "triggered_at", "signal_id", "signal_score", "success_rate_7d", "total_runs_7d"]
    return latest_per_key(gtm_trial_risk(b).select(*cols), ["organization_id"], [("triggered_at", "desc"), ("signal_id", "desc")])


_FINANCE_ROWS = """SELECT organization_id, revenue_month, organization_name, realized_revenue_usd, pending_revenue_usd, collection_rate_pct
  FROM fin_monthly_revenue ORDER BY revenue_month DESC, realized_revenue_usd DESC, organization_id LIMIT"""


@register("rpt_customer_risk_board", f"""
WITH board AS ({_FINANCE_ROWS} 100),
worst AS (SELECT organization_id, arg_max({{'p': signal_score, 's': success_rate_7d, 'n': total_runs_7d}}, ROW(triggered_at, signal_id)) AS r
          FROM gtm_trial_risk GROUP BY 1)
SELECT organization_id, organization_name, realized_revenue_usd, pending_revenue_usd, collection_rate_pct, ifnull(r.n, 0) AS runs_7d,
       ifnull(r.s, 0.0) AS success_rate_7d, round(100 * ifnull(r.p, 0.0), 2) AS risk_score
FROM board LEFT JOIN worst USING (organization_id)""", ("fin_monthly_revenue", "gtm_trial_risk"))
def rpt_customer_risk_board(b):
    """The 100 newest organisation-months by revenue; without a risk signal the risk is 0."""
    j = _finance_rows(b, 100).join(_latest_risk(b), "organization_id", "left")
    return j.select("organization_id", "organization_name", "realized_revenue_usd", "pending_revenue_usd", "collection_rate_pct",
                    F.coalesce("total_runs_7d", F.lit(0)).alias("runs_7d"),
                    F.coalesce("success_rate_7d", F.lit(0.0)).alias("success_rate_7d"),
                    F.round(F.coalesce("signal_score", F.lit(0.0)) * 100, 2).alias("risk_score"))


# Reliability and risk of an organisation without a signal.
NO_SIGNAL = (70.0, 35.0)


@register("rpt_momentum_score", f"""
WITH board AS ({_FINANCE_ROWS} 120),
worst AS (SELECT organization_id, arg_max([success_rate_7d * 100, signal_score * 100], ROW(triggered_at, signal_id)) AS r FROM gtm_trial_risk GROUP BY 1),
rated AS (SELECT board.*, ifnull(r[1], {NO_SIGNAL[0]}::DOUBLE) AS up, ifnull(r[2], {NO_SIGNAL[1]}::DOUBLE) AS down, ifnull(collection_rate_pct, 0) AS paid
          FROM board LEFT JOIN worst USING (organization_id))
SELECT organization_id, organization_name, revenue_month, realized_revenue_usd, pending_revenue_usd, paid AS collection_rate_pct,
       round(up, 2) AS reliability_pct, round(down, 2) AS risk_score,
       round(greatest(0, least(100, up * 0.5::DOUBLE + paid * 0.35::DOUBLE + (100 - down) * 0.15::DOUBLE)), 2) AS momentum_score
FROM rated ORDER BY realized_revenue_usd DESC, organization_id, revenue_month DESC LIMIT 100""",
          ("fin_monthly_revenue", "gtm_trial_risk"))
def rpt_momentum_score(b):
    """Half reliability, 35 % collection, 15 % absence of risk, 0 to 100."""
    j = _finance_rows(b, 120).join(_latest_risk(b), "organization_id", "left")
    up = F.coalesce(F.col("success_rate_7d") * 100, F.lit(NO_SIGNAL[0]))
    down = F.coalesce(F.col("signal_score") * 100, F.lit(NO_SIGNAL[1]))
    paid = F.coalesce("collection_rate_pct", F.lit(0.0))
    score = clamp(up * 0.5 + paid * 0.35 + (100 - down) * 0.15, 0.0, 100.0)
    return (j.select("organization_id", "organization_name", "revenue_month", "realized_revenue_usd", "pending_revenue_usd",
                     paid.alias("collection_rate_pct"), F.round(up, 2).alias("reliability_pct"), F.round(down, 2).alias("risk_score"),
                     F.round(score, 2).alias("momentum_score"))
            .orderBy(F.col("realized_revenue_usd").desc(), "organization_id", F.col("revenue_month").desc()).limit(100))


@register("rpt_mix_share", """SELECT p.plan_name, sum(p.monthly_price_usd) AS mrr_usd,
       round(sum(p.monthly_price_usd) / (SELECT total_mrr_usd FROM fin_mrr) * 100, 2) AS share_pct
FROM b_subscriptions a JOIN b_plans p ON a.plan_id = p.plan_id JOIN b_organizations o ON a.organization_id = o.organization_id
WHERE a.status = 'active' AND o.status = 'active' AND p.monthly_price_usd > 0 GROUP BY 1""",
          ("b_subscriptions", "b_plans", "b_organizations", "fin_mrr"))
def rpt_mix_share(b):
    a = b.subscriptions.filter(F.col("status") == "active").select("organization_id", "plan_id")
    p = F.broadcast(b.plans.select("plan_id", "plan_name", "monthly_price_usd"))
    o = b.organizations.filter(F.col("status") == "active").select("organization_id")
    j = a.join(p, "plan_id").join(o, "organization_id", "left_semi").filter(F.col("monthly_price_usd") > 0)
    g = j.groupBy("plan_name").agg(F.sum("monthly_price_usd").alias("mrr_usd"))
    total = fin_mrr(b).select("total_mrr_usd").scalar()  # scalar subquery
    return g.select("plan_name", "mrr_usd", safe_ratio("mrr_usd", total).alias("share_pct"))


@register("rpt_latest_change", """
WITH m AS (SELECT revenue_month, sum(CAST(round(realized_revenue_usd * 100) AS BIGINT)) AS c FROM fin_monthly_revenue GROUP BY 1),
l AS (SELECT revenue_month, c, lag(c) OVER (ORDER BY revenue_month) AS prev FROM m)
SELECT revenue_month, c / 100.0 AS revenue_usd, prev / 100.0 AS previous_revenue_usd,
       round((c - prev)::DOUBLE / nullif(prev, 0) * 100, 2) AS change_pct
FROM l WHERE revenue_month = (SELECT max(revenue_month) FROM m)""", ("fin_monthly_revenue",))
def rpt_latest_change(b):
    """Latest vs previous month: monthly totals (a bounded, calendar-sized
    frame) are ranked newest first and the top two compared."""
    m = fin_monthly_revenue(b).groupBy("revenue_month").agg(
        F.sum(F.round(F.col("realized_revenue_usd") * 100).cast("long")).alias("_c"))
    top2 = m.orderBy(F.col("revenue_month").desc()).limit(2)
    latest = top2.agg(F.max_by(F.struct("revenue_month", "_c"), "revenue_month").alias("cur"),
                      F.min_by(F.struct("revenue_month", "_c"), "revenue_month").alias("prev"),
                      F.count(F.lit(1)).alias("_n"))
    prev_c = F.when(F.col("_n") == 2, F.col("prev._c"))
    return latest.select(F.col("cur.revenue_month").alias("revenue_month"), (F.col("cur._c") / 100.0).alias("revenue_usd"),
                         (prev_c / 100.0).alias("previous_revenue_usd"), pct_change(F.col("cur._c"), prev_c).alias("change_pct"))


# Metric, green bound, yellow bound, whether higher is better; a money
# metric is green above zero and yellow otherwise.
STATUS_BANDS = (("30d success rate", 95.0, 90.0, True), ("30d timeout rate", 2.0, 4.0, False),
                ("30d errors per 1k sessions", 8.0, 15.0, False), ("7d activation rate", 40.0, 25.0, True),
                ("Total MRR", 0.0, None, True), ("Open pipeline", 0.0, None, True))


@register("rpt_status_bands", """
SELECT metric, value, CASE WHEN sign * value >= sign * green THEN 'green' WHEN sign * value >= sign * yellow THEN 'yellow' ELSE 'red' END AS status
FROM (SELECT unnest(['30d success rate', '30d timeout rate', '30d errors per 1k sessions', '7d activation rate']) AS metric,
             ifnull(unnest([avg_success_rate_pct_30d, avg_timeout_rate_pct_30d, avg_errors_per_1k_sessions_30d, avg_activation_rate_7d_pct]), 0) AS value,
             unnest([95, 2, 8, 40]) AS green, unnest([90, 4, 15, 25]) AS yellow, unnest([1, -1, -1, 1]) AS sign
      FROM eng_kpis POSITIONAL JOIN gtm_growth_kpis)
UNION ALL
SELECT metric, ifnull(value, 0), if(value > 0, 'green', 'yellow')
FROM (SELECT 'Total MRR' AS metric, CAST(total_mrr_usd AS DOUBLE) AS value FROM fin_mrr
      UNION ALL SELECT 'Open pipeline', CAST(open_pipeline_usd AS DOUBLE) FROM gtm_pipeline_snapshot)""",
          ("eng_kpis", "gtm_growth_kpis", "fin_mrr", "gtm_pipeline_snapshot"))
def rpt_status_bands(b):
    """Six headline metrics with a green, yellow or red band each; a missing value counts as 0."""
    e = eng_kpis(b)
    values = (e.select("avg_success_rate_pct_30d"), e.select("avg_timeout_rate_pct_30d"), e.select("avg_errors_per_1k_sessions_30d"),
              gtm_growth_kpis(b).select("avg_activation_rate_7d_pct"), fin_mrr(b).select("total_mrr_usd"),
              gtm_pipeline_snapshot(b).select("open_pipeline_usd"))
    out = None
    for frame, (metric, green, yellow, higher) in zip(values, STATUS_BANDS, strict=True):
        v = F.coalesce(F.col(frame.columns[0]).cast("double"), F.lit(0.0))
        if yellow is None:
            st = F.when(v > green, "green").otherwise("yellow")
        else:
            st = F.when(v >= green if higher else v <= green, "green").when(v >= yellow if higher else v <= yellow, "yellow").otherwise("red")
        part = frame.select(F.lit(metric).alias("metric"), v.alias("value"), st.alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


@register("rpt_due_soon", f"""SELECT task_id, organization_name, priority, due_at FROM gtm_task_queue
WHERE due_at <= {AS_OF_TS_SQL} + INTERVAL 48 HOUR ORDER BY due_at, task_id""", ("gtm_task_queue",))
def rpt_due_soon(b):
    lim = F.lit(f"{b.as_of} 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL 48 HOURS")
    return (gtm_task_queue(b).filter(F.col("due_at") <= lim)
            .select("task_id", "organization_name", "priority", "due_at").orderBy("due_at", "task_id"))


@register("rpt_reason_breakdown", """SELECT reason_code, count(*) AS signals, round(avg(signal_score), 4) AS avg_risk
FROM gtm_trial_risk GROUP BY 1 ORDER BY signals DESC, reason_code LIMIT 5""", ("gtm_trial_risk",))
def rpt_reason_breakdown(b):
    r = gtm_trial_risk(b).groupBy("reason_code").agg(F.count(F.lit(1)).alias("signals"),
                                                     F.round(exact_avg("signal_score", 4), 4).alias("avg_risk"))
    return r.orderBy(F.col("signals").desc(), "reason_code").limit(5)


@register("rpt_funnel_step_rates", """
SELECT metric_date, leads_created, qualified_leads_created, leads_converted,
       ifnull(round(100.0::DOUBLE * qualified_leads_created / nullif(leads_created, 0), 2), 0) AS lead_to_qualified_pct,
       ifnull(round(100.0::DOUBLE * leads_converted / nullif(qualified_leads_created, 0), 2), 0) AS qualified_to_converted_pct
FROM gtm_funnel_daily ORDER BY metric_date DESC LIMIT 1""", ("gtm_funnel_daily",))
def rpt_funnel_step_rates(b):
    """Step rates of the latest day; a step from nothing has the rate 0."""
    return gtm_funnel_daily(b).orderBy(F.col("metric_date").desc()).limit(1).select(
        "metric_date", "leads_created", "qualified_leads_created", "leads_converted",
        F.coalesce(safe_ratio("qualified_leads_created", "leads_created"), F.lit(0.0)).alias("lead_to_qualified_pct"),
        F.coalesce(safe_ratio("leads_converted", "qualified_leads_created"), F.lit(0.0)).alias("qualified_to_converted_pct"))


@register("rpt_source_share", """SELECT spend_source, c / 100.0 AS spend_usd, round(c::DOUBLE / sum(c) OVER () * 100, 2) AS share_pct
FROM (SELECT spend_source, sum(CAST(round(spend_usd * 100) AS BIGINT)) AS c FROM fin_spend_monthly GROUP BY 1)""",
          ("fin_spend_monthly",))
def rpt_source_share(b):
    s = fin_spend_monthly(b).groupBy("spend_source").agg(F.sum(F.round(F.col("spend_usd") * 100).cast("long")).alias("_c"))
    total = s.agg(F.sum("_c")).scalar()  # scalar subquery
    return s.select("spend_source", (F.col("_c") / 100.0).alias("spend_usd"), safe_ratio("_c", total).alias("share_pct"))


@register("rpt_tie_out", """
SELECT coalesce(a.k, m.k) AS metric_date, a.v AS mart_success_pct, m.v AS metric_success_pct,
       CASE WHEN a.k IS NULL OR m.k IS NULL THEN 'missing' WHEN abs(a.v - m.v) <= 0.01 THEN 'match' ELSE 'mismatch' END AS status,
       round(coalesce(a.v, 0) - coalesce(m.v, 0), 2) AS delta
FROM (SELECT metric_date AS k, success_rate_pct AS v FROM eng_daily) a
FULL OUTER JOIN (SELECT date AS k, success_rate_pct AS v FROM core_daily_kpis) m ON a.k = m.k""",
          ("eng_daily", "core_daily_kpis"))
def rpt_tie_out(b):
    a = eng_daily(b).select(F.col("metric_date").alias("k"), F.col("success_rate_pct").alias("av"))
    m = core_daily_kpis(b).select(F.col("date").alias("k2"), F.col("success_rate_pct").alias("mv"))
    j = a.join(m, F.col("k") == F.col("k2"), "full")
    st = (F.when(F.col("k").isNull() | F.col("k2").isNull(), "missing")
          .when(F.abs(F.col("av") - F.col("mv")) <= 0.01, "match").otherwise("mismatch"))
    return j.select(F.coalesce("k", "k2").alias("metric_date"), F.col("av").alias("mart_success_pct"),
                    F.col("mv").alias("metric_success_pct"), st.alias("status"),
                    F.round(F.coalesce("av", F.lit(0.0)) - F.coalesce("mv", F.lit(0.0)), 2).alias("delta"))
