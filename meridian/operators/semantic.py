"""A semantic metrics layer: named measures over a model (a DataFrame), simple
metrics (a measure), ratio metrics (ratio of sums, never an average of
ratios) and derived metrics (arithmetic over metrics), queried at a time grain
and by categorical dimensions.  A query compiles to ONE grouped aggregation
(partial + final aggregate in Spark) followed by a projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import exact_sum


@dataclass(frozen=True)
class Measure:
    expr: str                 # column summed
    digits: int | None = None  # decimals carried by the column -> exact, order-independent sum


@dataclass
class SemanticModel:
    name: str
    time_dimension: str
    dimensions: Sequence[str]
    measures: dict[str, Measure]
    simple: dict[str, str] = field(default_factory=dict)                    # metric -> measure
    ratios: dict[str, tuple[str, str]] = field(default_factory=dict)        # metric -> (num metric, den metric)
    derived: dict[str, Callable[[dict[str, Column]], Column]] = field(default_factory=dict)
    derived_inputs: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _measure_col(m: Measure) -> Column:
    return exact_sum(m.expr, m.digits) if m.digits is not None else F.sum(m.expr)


def time_key(col: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(col).cast("timestamp")).cast("date")


def query(model: SemanticModel, df: DataFrame, metrics: Sequence[str], dims: Sequence[str] = (),
          grain: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Evaluate ``metrics`` grouped by the time grain (None = whole range) and ``dims``."""
    t = model.time_dimension
    if start is not None:
        df = df.filter(F.col(t) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(t) <= F.lit(end).cast("date"))

    def simple_inputs(metric: str) -> list[str]:
        if metric in model.simple:
            return [metric]
        if metric in model.ratios:
            return list(model.ratios[metric])
        return [x for m in model.derived_inputs[metric] for x in simple_inputs(m)]

    needed = sorted({s for m in metrics for s in simple_inputs(m)})
    keys = ([time_key(t, grain).alias(f"metric_{grain}")] if grain else []) + [F.col(d) for d in dims]
    aggs = [_measure_col(model.measures[model.simple[s]]).alias(s) for s in needed]
    agg = (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)
    cols = {s: F.col(s) for s in needed}
    out = []
    for m in metrics:
        if m in model.simple:
            out.append(F.col(m))
        elif m in model.ratios:
            num, den = model.ratios[m]
            out.append(F.round(F.col(num).cast("double") / F.nullif(F.col(den).cast("double"), F.lit(0.0)), 4).alias(m))
        else:
            out.append(model.derived[m](cols).alias(m))
    key_names = ([f"metric_{grain}"] if grain else []) + list(dims)
    return agg.select(*key_names, *out)


# The three semantic models, their measures and metrics.
def spine_model() -> SemanticModel:
    return SemanticModel(
        name="metric_spine_semantic", time_dimension="metric_date", dimensions=["organization_id", "is_active_org"],
        measures={
            "metric_spine_session_count": Measure("session_count"),
            "metric_spine_successful_session_count": Measure("successful_session_count"),
            "metric_spine_event_count": Measure("event_count"),
            "metric_spine_error_count": Measure("error_count"),
            "metric_spine_session_duration_minutes": Measure("session_duration_minutes", 2),
            "metric_spine_subscription_mrr_usd": Measure("subscription_mrr_usd", 2),
            "metric_spine_active_org_days": Measure("is_active_org"),
            "metric_spine_new_organization_count": Measure("new_organization_count"),
            "metric_spine_new_user_count": Measure("new_user_count"),
        },
        simple={"total_sessions": "metric_spine_session_count",
                "total_successful_sessions": "metric_spine_successful_session_count",
                "total_events": "metric_spine_event_count", "total_errors": "metric_spine_error_count",
                "total_session_minutes": "metric_spine_session_duration_minutes",
                "total_mrr_usd": "metric_spine_subscription_mrr_usd", "active_org_days": "metric_spine_active_org_days",
                "total_new_organizations": "metric_spine_new_organization_count",
                "total_new_users": "metric_spine_new_user_count"},
        ratios={"session_success_rate": ("total_successful_sessions", "total_sessions"),
                "error_rate_per_event": ("total_errors", "total_events"),
                "mrr_per_active_org_day": ("total_mrr_usd", "active_org_days")},
        derived={"session_failures": lambda c: c["total_sessions"] - c["total_successful_sessions"]},
        derived_inputs={"session_failures": ("total_sessions", "total_successful_sessions")},
    )


def daily_kpis_model() -> SemanticModel:
    return SemanticModel(
        name="daily_kpis_semantic", time_dimension="date", dimensions=[],
        measures={"daily_kpis_total_sessions": Measure("total_sessions"),
                  "daily_kpis_successful_sessions": Measure("successful_sessions"),
                  "daily_kpis_failed_sessions": Measure("failed_sessions"),
                  "daily_kpis_new_organizations": Measure("new_organizations"),
                  "daily_kpis_new_users": Measure("new_users")},
        simple={"kpi_total_sessions": "daily_kpis_total_sessions",
                "kpi_successful_sessions": "daily_kpis_successful_sessions",
                "kpi_failed_sessions": "daily_kpis_failed_sessions",
                "kpi_new_organizations": "daily_kpis_new_organizations", "kpi_new_users": "daily_kpis_new_users"},
        ratios={"kpi_session_success_rate": ("kpi_successful_sessions", "kpi_total_sessions")},
    )


def snapshot_model() -> SemanticModel:
    return SemanticModel(
        name="business_snapshot_monthly_semantic", time_dimension="month_start",
        dimensions=["organization_id", "organization_status", "current_plan_name"],
        measures={"snapshot_total_runs": Measure("total_runs"), "snapshot_successful_runs": Measure("successful_runs"),
                  "snapshot_revenue_usd": Measure("recognized_revenue_usd", 2),
                  "snapshot_spend_usd": Measure("total_spend_usd", 2), "snapshot_new_leads": Measure("new_leads"),
                  "snapshot_new_opportunities": Measure("new_opportunities"),
                  "snapshot_won_opportunities": Measure("won_opportunities")},
        simple={"monthly_total_runs": "snapshot_total_runs", "monthly_successful_runs": "snapshot_successful_runs",
                "monthly_revenue_usd": "snapshot_revenue_usd", "monthly_spend_usd": "snapshot_spend_usd",
                "monthly_new_leads": "snapshot_new_leads", "monthly_new_opportunities": "snapshot_new_opportunities",
                "monthly_won_opportunities": "snapshot_won_opportunities"},
        ratios={"monthly_run_success_rate": ("monthly_successful_runs", "monthly_total_runs"),
                "monthly_pipeline_efficiency": ("monthly_won_opportunities", "monthly_new_opportunities")},
        derived={"monthly_gross_margin_proxy_usd":
                 lambda c: F.round(c["monthly_revenue_usd"] - c["monthly_spend_usd"], 2)},
        derived_inputs={"monthly_gross_margin_proxy_usd": ("monthly_revenue_usd", "monthly_spend_usd")},
    )
