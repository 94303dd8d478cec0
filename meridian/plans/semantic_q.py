"""Semantic-layer queries over the three semantic models (org x day spine,
daily KPIs, monthly business snapshot)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import semantic as S
from .oracle_views import AS_OF_SQL
from .registry import register
from .terminal import core_daily_kpis, core_metric_spine, term_business_snapshot


def _xs(col: str, digits: int = 2) -> str:
    scale = 10 ** digits
    return f"sum(CAST(round({col} * {scale}) AS BIGINT)) / {scale}.0"


def _ratio(num: str, den: str) -> str:
    return f"round(({num})::DOUBLE / nullif(({den})::DOUBLE, 0), 4)"


SPINE_SIMPLE = ["total_sessions", "total_successful_sessions", "total_events", "total_errors", "total_session_minutes",
                "total_mrr_usd", "active_org_days", "total_new_organizations", "total_new_users"]


@register("sem_measure", f"""SELECT CAST(sum(session_count) AS BIGINT) AS total_sessions,
       CAST(sum(successful_session_count) AS BIGINT) AS total_successful_sessions,
       CAST(sum(event_count) AS BIGINT) AS total_events, CAST(sum(error_count) AS BIGINT) AS total_errors,
       {_xs('session_duration_minutes')} AS total_session_minutes, {_xs('subscription_mrr_usd')} AS total_mrr_usd,
       CAST(sum(is_active_org) AS BIGINT) AS active_org_days,
       CAST(sum(new_organization_count) AS BIGINT) AS total_new_organizations,
       CAST(sum(new_user_count) AS BIGINT) AS total_new_users
FROM core_metric_spine""", ("core_metric_spine",))
def sem_measure(b):
    """Every measure of the spine model summed over the whole range."""
    return S.query(S.spine_model(), core_metric_spine(b), SPINE_SIMPLE)


@register("sem_simple", f"""SELECT CAST(date_trunc('day', date) AS DATE) AS metric_day,
       CAST(sum(total_sessions) AS BIGINT) AS kpi_total_sessions, CAST(sum(new_organizations) AS BIGINT) AS kpi_new_organizations
FROM core_daily_kpis WHERE date >= {AS_OF_SQL} - INTERVAL 30 DAY AND date <= {AS_OF_SQL} GROUP BY 1""", ("core_daily_kpis",))
def sem_simple(b):
    start = (dt.date.fromisoformat(b.as_of) - dt.timedelta(days=30)).isoformat()
    return S.query(S.daily_kpis_model(), core_daily_kpis(b), ["kpi_total_sessions", "kpi_new_organizations"],
                   [], "day", start, b.as_of)


@register("sem_ratio", f"""SELECT CAST(date_trunc('month', metric_date) AS DATE) AS metric_month,
       {_ratio('sum(successful_session_count)', 'sum(session_count)')} AS session_success_rate,
       {_ratio('sum(error_count)', 'sum(event_count)')} AS error_rate_per_event,
       {_ratio(_xs('subscription_mrr_usd'), 'sum(is_active_org)')} AS mrr_per_active_org_day
FROM core_metric_spine GROUP BY 1""", ("core_metric_spine",))
def sem_ratio(b):
    return S.query(S.spine_model(), core_metric_spine(b),
                   ["session_success_rate", "error_rate_per_event", "mrr_per_active_org_day"], [], "month")


@register("sem_derived", f"""
SELECT s.metric_month, s.session_failures, m.monthly_gross_margin_proxy_usd FROM
  (SELECT CAST(date_trunc('month', metric_date) AS DATE) AS metric_month,
          CAST(sum(session_count) - sum(successful_session_count) AS BIGINT) AS session_failures
   FROM core_metric_spine GROUP BY 1) s
LEFT JOIN
  (SELECT CAST(date_trunc('month', month_start) AS DATE) AS metric_month,
          round({_xs('recognized_revenue_usd')} - {_xs('total_spend_usd')}, 2) AS monthly_gross_margin_proxy_usd
   FROM term_business_snapshot GROUP BY 1) m ON s.metric_month = m.metric_month""",
          ("core_metric_spine", "term_business_snapshot"))
def sem_derived(b):
    s = S.query(S.spine_model(), core_metric_spine(b), ["session_failures"], [], "month")
    m = S.query(S.snapshot_model(), term_business_snapshot(b), ["monthly_gross_margin_proxy_usd"], [], "month")
    return s.join(m, "metric_month", "left")


@register("sem_time_grain", f"""SELECT CAST(date_trunc('quarter', month_start) AS DATE) AS metric_quarter,
       CAST(sum(total_runs) AS BIGINT) AS monthly_total_runs, {_xs('recognized_revenue_usd')} AS monthly_revenue_usd,
       {_ratio('sum(successful_runs)', 'sum(total_runs)')} AS monthly_run_success_rate
FROM term_business_snapshot GROUP BY 1""", ("term_business_snapshot",))
def sem_time_grain(b):
    return S.query(S.snapshot_model(), term_business_snapshot(b),
                   ["monthly_total_runs", "monthly_revenue_usd", "monthly_run_success_rate"], [], "quarter")


@register("sem_categorical_dim", f"""SELECT organization_status, current_plan_name,
       {_xs('recognized_revenue_usd')} AS monthly_revenue_usd,
       {_ratio('sum(won_opportunities)', 'sum(new_opportunities)')} AS monthly_pipeline_efficiency
FROM term_business_snapshot GROUP BY 1, 2""", ("term_business_snapshot",))
def sem_categorical_dim(b):
    return S.query(S.snapshot_model(), term_business_snapshot(b), ["monthly_revenue_usd", "monthly_pipeline_efficiency"],
                   ["organization_status", "current_plan_name"])
