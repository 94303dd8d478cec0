"""Cross-domain metrics: daily KPIs, org x day spine, terminal marts, scorecard."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_if, exact_avg, exact_sum, month_start, safe_div, safe_ratio
from ..operators.shapes import dated_measures, explode_months, gap_rows, gap_spread
from .core import dim_organizations, dim_users, fct_sessions
from .finance import fin_firm_unit_economics, fin_monthly_revenue, fin_mrr, revenue_facts
from .finance_ops import BUDGET_FACTS, budget_columns, budget_facts, department_budgets, fin_budget_vs_actual, fin_spend_monthly
from .growth import gtm_funnel_daily, gtm_growth_daily, gtm_pipeline_snapshot, gtm_task_queue, gtm_trial_risk
from .oracle_views import AS_OF_SQL, view
from .product import eng_daily, eng_kpis, ops_daily, pro_product_daily
from .registry import register


def attach_scalars(base: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Attach single-row relations (global aggregates) to every row of ``base``.

    Each frame passed here is a keyless aggregate, i.e. exactly one row, so the
    broadcast is bounded by construction.
    """
    return reduce(lambda acc, r: acc.crossJoin(F.broadcast(r)), one_row, base)


def _calendar_join(frames_keys: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """One row per key of any frame with the columns of all of them.

    The frames have one row per key each, so their stacked rows meet in one
    group and no frame is computed a second time for its keys.  As in a join, a
    NULL key takes no values.
    """
    names = [c for f, k in frames_keys for c in f.columns if c != k]
    stacked = reduce(lambda a, b2: a.unionByName(b2, allowMissingColumns=True),
                     [f.select(F.col(k).alias(key), *[F.when(F.col(k).isNotNull(), F.col(c)).alias(c) for c in f.columns if c != k])
                      for f, k in frames_keys])
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in names])


# ------------------------------------------------------------ daily KPIs
def core_daily_kpis(b) -> DataFrame:
    s = fct_sessions(b)
    ds = s.groupBy("session_date").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.countDistinct("organization_id").alias("active_orgs"),
        count_if(F.col("is_successful")).alias("successful_sessions"),
        F.sum("duration_seconds").alias("_dur"), F.sum("total_bytes_transferred").alias("_bytes"),
        F.sum("pages_visited").alias("_pages"))
    no = (b.organizations.groupBy(F.to_date("created_at").alias("session_date"))
          .agg(F.count(F.lit(1)).alias("new_organizations")))
    nu = dim_users(b).groupBy(F.to_date("user_created_at").alias("session_date")).agg(F.count(F.lit(1)).alias("new_users"))
    j = ds.join(no, "session_date", "left").join(nu, "session_date", "left")
    return j.select(
        F.col("session_date").alias("date"), "total_sessions", "successful_sessions",
        (F.col("total_sessions") - F.col("successful_sessions")).alias("failed_sessions"),
        safe_ratio("successful_sessions", "total_sessions").alias("success_rate_pct"),
        F.col("active_orgs").alias("daily_active_organizations"), F.col("_pages").alias("pages_visited"),
        F.round(F.col("_dur") / 60.0, 2).alias("total_session_minutes"),
        F.round(F.col("_bytes") / 1024.0 / 1024.0 / 1024.0, 2).alias("total_gb_transferred"),
        F.coalesce("new_organizations", F.lit(0)).alias("new_organizations"),
        F.coalesce("new_users", F.lit(0)).alias("new_users"),
        safe_ratio("_dur", "total_sessions", 1.0).alias("avg_session_duration_seconds"),
        safe_ratio("_pages", "total_sessions", 1.0).alias("avg_pages_per_session"))


view("core_daily_kpis", """
WITH told AS (  -- sessions, sign-ups and joiners as events of a day
  SELECT session_date AS date, organization_id AS org, is_successful AS ok, pages_visited AS pages, duration_seconds AS secs, total_bytes_transferred AS bytes, 1 AS run FROM fct_sessions
  UNION ALL BY NAME SELECT CAST(organization_created_at AS DATE) AS date, 1 AS signed FROM dim_organizations
  UNION ALL BY NAME SELECT CAST(user_created_at AS DATE) AS date, 1 AS joined FROM dim_users)
SELECT date, count(run) AS total_sessions, count(*) FILTER (ok) AS successful_sessions, count(run) - count(*) FILTER (ok) AS failed_sessions,
       round(100.0::DOUBLE * count(*) FILTER (ok) / count(run), 2) AS success_rate_pct, count(DISTINCT org) AS daily_active_organizations,
       CAST(sum(pages) AS BIGINT) AS pages_visited, round(CAST(sum(secs) AS BIGINT) / 60.0, 2) AS total_session_minutes,
       round(CAST(sum(bytes) AS BIGINT) / 1024.0 / 1024.0 / 1024.0, 2) AS total_gb_transferred, count(signed) AS new_organizations, count(joined) AS new_users,
       round(sum(secs)::DOUBLE / count(run), 2) AS avg_session_duration_seconds, round(sum(pages)::DOUBLE / count(run), 2) AS avg_pages_per_session
FROM told GROUP BY date HAVING count(run) > 0
""", "fct_sessions", "dim_organizations", "dim_users")
register("core_daily_kpis", "SELECT * FROM core_daily_kpis", ("core_daily_kpis",),
         inputs=("fct_sessions", "dim_organizations", "dim_users"))(core_daily_kpis)


# ------------------------------------------------------------- metric spine
def subscription_daily_mrr(b) -> DataFrame:
    """Org x day MRR of active paid subscriptions, summed per org-day.

    Days are generated per subscription with ``explode(sequence)``, capped at
    ``as_of`` (open-ended subscriptions would otherwise run to 2999).
    """
    as_of = F.lit(b.as_of).cast("date")
    s = b.subscriptions.filter(F.col("status") == "active")
    p = F.broadcast(b.plans.select("plan_id", "monthly_price_usd"))  # bounded catalogue
    s = s.join(p, "plan_id", "left").filter(F.col("monthly_price_usd") > 0)
    end = F.least(F.to_date(F.coalesce("current_period_end", F.lit(f"{b.as_of} 00:00:00").cast("timestamp_ntz"))), as_of)
    days = (s.filter(F.to_date("current_period_start") <= end)
            .select("organization_id", "monthly_price_usd",
                    F.explode(F.sequence(F.to_date("current_period_start"), end)).alias("metric_date")))
    return days.groupBy("organization_id", "metric_date").agg(F.sum("monthly_price_usd").alias("subscription_mrr_usd"))


def mrr_changes(b, start: DataFrame) -> DataFrame:
    """``organization_id, day, __mrr``: by how many cents an organisation's MRR changes on a day.

    An active paid subscription adds its price on its first day and takes it
    away after its last one; days before the organisation's ``start`` count as
    that day, days after ``as_of`` are left out.
    """
    as_of = F.lit(b.as_of).cast("date")
    p = F.broadcast(b.plans.select("plan_id", F.round(F.col("monthly_price_usd") * 100).cast("long").alias("__cents")))  # bounded catalogue
    s = b.subscriptions.filter(F.col("status") == "active").join(p, "plan_id").filter(F.col("__cents") > 0)
    first = F.to_date("current_period_start")
    last = F.least(F.to_date(F.coalesce("current_period_end", F.lit(f"{b.as_of} 00:00:00").cast("timestamp_ntz"))), as_of)
    both = F.explode(F.array(F.struct(first.alias("day"), F.col("__cents").alias("__mrr")),
                             F.struct(F.date_add(last, 1).alias("day"), (-F.col("__cents")).alias("__mrr")))).alias("e")
    found = s.filter(first <= last).select("organization_id", both).select("organization_id", "e.day", "e.__mrr").filter(F.col("day") <= as_of)
    # Few rows per organisation and day; the sum reduces them before they meet the organisations.
    found = found.groupBy("organization_id", "day").agg(F.sum("__mrr").alias("__mrr"))
    return found.join(start, "organization_id").select("organization_id", F.greatest("day", "start").alias("day"), "__mrr")


def core_metric_spine(b) -> DataFrame:
    """Org x day from the organisation's creation to ``as_of`` with activity,
    MRR and new-entity counts.

    Sessions, users, organisations and changes of MRR are stacked and summed by
    (organisation, day); the days without any are filled in behind the last
    exchange (``gap_rows``), so spine rows never travel.
    """
    d0 = b.sessions.agg(F.min(F.to_date("started_at"))).scalar()  # scalar subquery: first calendar day
    as_of, zero = F.lit(b.as_of).cast("date"), F.lit(0).cast("long")
    orgs = b.organizations.select("organization_id", F.to_date("created_at").alias("created"))  # same rows as the dimension
    starts = orgs.select("organization_id", "created", F.greatest(F.col("created"), d0).alias("start"))
    facts = [
        fct_sessions(b).select("organization_id", F.col("session_date").alias("metric_date"), F.lit(1).alias("_n"), F.col("is_successful").cast("int").alias("_ok"),
                               F.col("event_count").alias("_ev"), F.col("error_count").alias("_err"), F.col("duration_seconds").alias("_dur")),
        starts.select("organization_id", F.col("start").alias("metric_date"), "start"),
        starts.select("organization_id", F.col("created").alias("metric_date"), F.lit(1).alias("_new_org")),
        dim_users(b).filter(F.col("primary_organization_id").isNotNull()).select(
            F.col("primary_organization_id").alias("organization_id"), F.to_date("user_created_at").alias("metric_date"), F.lit(1).alias("_new_users")),
        mrr_changes(b, starts.select("organization_id", "start")).withColumnRenamed("day", "metric_date"),
    ]
    own = ["_n", "_ok", "_ev", "_err", "_dur", "_new_org", "_new_users"]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), facts)
    sparse = rows.filter(F.col("metric_date") <= as_of).groupBy("organization_id", "metric_date").agg(
        *[F.sum(c).alias(c) for c in [*own, "__mrr"]], F.max("start").alias("__start"))
    rows = gap_rows(sparse, "organization_id", "metric_date", as_of, own=own, carried=["__mrr"])

    def figures(x, mrr: str) -> dict[str, Column]:
        z = lambda c: F.coalesce(x(c), zero)
        n = z("_n")
        return {
            "session_count": n,
            "successful_session_count": z("_ok"),
            "session_success_rate_pct": F.when(n == 0, F.lit(0.0)).otherwise(F.round(z("_ok").cast("double") / n * 100, 2)),
            "is_active_org": F.when(n > 0, 1).otherwise(0),
            "event_count": z("_ev"), "error_count": z("_err"),
            "session_duration_minutes": F.round(z("_dur") / 60.0, 2),
            "subscription_mrr_usd": F.col(mrr) / 100.0,
            "new_organization_count": z("_new_org").cast("int"),
            "new_user_count": z("_new_users")}

    told, empty = figures(F.col, "__upto___mrr"), figures(without(rows, own), "__upto___mrr")
    del empty["subscription_mrr_usd"]  # holds until the next change
    return gap_spread(rows, "organization_id", "metric_date", "DAY", told, empty).select("metric_date", "organization_id", *told)


def without(rows: DataFrame, own: Sequence[str]) -> Callable[[str], Column]:
    """Gives the columns of ``rows`` as they are in a period without facts: those in ``own`` are NULL."""
    types = {f.name: f.dataType for f in rows.schema}
    return lambda c: F.lit(None).cast(types[c]) if c in own else F.col(c)


view("sub_daily_mrr", f"""
SELECT s.organization_id, CAST(gs.day AS DATE) AS metric_date, sum(p.monthly_price_usd) AS subscription_mrr_usd
FROM fct_subscriptions s LEFT JOIN b_plans p ON s.plan_id = p.plan_id,
     LATERAL (SELECT unnest(generate_series(CAST(s.current_period_start AS DATE),
              least(CAST(coalesce(s.current_period_end, TIMESTAMP '2001-08-01 00:00:00') AS DATE), {AS_OF_SQL}),
              INTERVAL 1 DAY)) AS day) gs
WHERE s.status = 'active' AND p.monthly_price_usd > 0
GROUP BY 1, 2
""", "fct_subscriptions", "b_plans")

view("core_metric_spine", f"""
WITH told AS (  -- what happens to an organisation on a day; 'cell' says that the day is on its spine, 'step' by how much its MRR changes
  SELECT organization_id, CAST(unnest(generate_series(greatest(CAST(organization_created_at AS DATE), (SELECT min(date_day) FROM dim_time)), {AS_OF_SQL}, INTERVAL 1 DAY)) AS DATE) AS metric_date, 1 AS cell
  FROM dim_organizations
  UNION ALL BY NAME SELECT organization_id, session_date AS metric_date, 1 AS run, is_successful AS ok, event_count AS ev, error_count AS err, duration_seconds AS secs FROM fct_sessions
  UNION ALL BY NAME SELECT organization_id, CAST(organization_created_at AS DATE) AS metric_date, 1 AS born FROM dim_organizations
  UNION ALL BY NAME SELECT primary_organization_id AS organization_id, CAST(user_created_at AS DATE) AS metric_date, 1 AS joined FROM dim_users
  UNION ALL BY NAME SELECT organization_id, unnest([a, z + 1]) AS metric_date, unnest([price, -price]) AS step
  FROM (SELECT organization_id, monthly_price_usd::DECIMAL(18, 2) AS price, CAST(current_period_start AS DATE) AS a, CAST(ifnull(current_period_end, TIMESTAMP '2001-08-01') AS DATE) AS z
        FROM fct_subscriptions JOIN b_plans USING (plan_id) WHERE status = 'active' AND monthly_price_usd > 0) WHERE z >= a),
days AS (
  SELECT organization_id, metric_date, count(cell) AS cells, count(run) AS runs, count(*) FILTER (ok) AS oks, sum(ev) AS ev, sum(err) AS err, sum(secs) AS secs, count(born) AS born, count(joined) AS joined,
         sum(ifnull(sum(step), 0)) OVER (PARTITION BY organization_id ORDER BY metric_date) AS mrr
  FROM told GROUP BY organization_id, metric_date)
SELECT metric_date, organization_id, runs AS session_count, oks AS successful_session_count, ifnull(round(100.0::DOUBLE * oks / nullif(runs, 0), 2), 0.0) AS session_success_rate_pct,
       (runs > 0)::INT AS is_active_org, CAST(ifnull(ev, 0) AS BIGINT) AS event_count, CAST(ifnull(err, 0) AS BIGINT) AS error_count,
       round(CAST(ifnull(secs, 0) AS BIGINT) / 60.0, 2) AS session_duration_minutes, CAST(mrr AS DOUBLE) AS subscription_mrr_usd,
       CAST(born AS INTEGER) AS new_organization_count, joined AS new_user_count
FROM days WHERE cells > 0
""", "dim_organizations", "dim_time", "fct_sessions", "dim_users", "fct_subscriptions", "b_plans")
register("core_metric_spine", "SELECT * FROM core_metric_spine", ("core_metric_spine",),
         inputs=("dim_organizations", "dim_time", "fct_sessions", "dim_users", "fct_subscriptions",
                 "stg_plans"))(core_metric_spine)


# --------------------------------------------------------- metric registry
# Certified metric definitions of this engine
# (metric_name, domain, grain, source_model, definition, owner, is_certified).
METRIC_REGISTRY_ROWS = [
    ("total_mrr_usd", "finance", "snapshot", "fin_mrr", "sum of monthly price of active paid subscriptions", "finance", True),
    ("realized_revenue_usd", "finance", "month", "fin_monthly_revenue", "sum of paid invoice totals", "finance", True),
    ("collection_rate_pct", "finance", "month", "fin_monthly_revenue", "realized / gross revenue x 100", "finance", True),
    ("daily_active_organizations", "product", "day", "core_daily_kpis", "distinct organisations with a session", "product", True),
    ("success_rate_pct", "engineering", "day", "eng_daily", "completed / total sessions x 100", "engineering", True),
    ("p95_duration_seconds", "engineering", "day", "eng_daily", "95th percentile of session duration", "engineering", True),
    ("activation_rate_7d_pct", "growth", "day", "gtm_growth_daily", "orgs with a session within 7 days of signup", "growth", True),
    ("open_pipeline_usd", "growth", "snapshot", "gtm_pipeline_snapshot", "amount of open opportunities", "sales", True),
    ("gross_margin_pct", "finance", "month", "fin_firm_unit_economics", "(revenue - expected cost) / revenue x 100", "finance", False),
    ("utilization_pct", "finance", "month", "fin_firm_unit_economics", "session hours / entitled hours x 100", "finance", False),
]
REGISTRY_SCHEMA = ("metric_name string, domain string, grain string, source_model string, definition string, "
                   "owner string, is_certified boolean")


def core_metric_registry(b) -> DataFrame:
    return b.spark.createDataFrame(METRIC_REGISTRY_ROWS, REGISTRY_SCHEMA)


# Fixed configuration relation: a library function, not a registered query (it reads no input tables).


def monthly_mrr(b) -> DataFrame:
    """``organization_id, month_start, __mrr, _peak`` for months in which an
    organisation's MRR changes: by how many cents it has changed at the month's
    end, and the highest it gets above its level before the month.

    Only days with a change are looked at; the level before the month is a
    candidate unless the organisation's spine or the month begins with a change.
    """
    d0 = b.sessions.agg(F.min(F.to_date("started_at"))).scalar()
    starts = b.organizations.select("organization_id", F.greatest(F.to_date("created_at"), d0).alias("start"))
    daily = mrr_changes(b, starts).groupBy("organization_id", "day").agg(F.sum("__mrr").alias("d"))
    month = F.trunc("day", "MM").alias("month_start")
    w = Window.partitionBy("organization_id", "month_start").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # 31 rows at most
    run = daily.select("organization_id", month, "day", "d").withColumn("r", F.sum("d").over(w))
    monthly = run.groupBy("organization_id", "month_start").agg(F.sum("d").alias("__mrr"), F.max("r").alias("_top"), F.min("day").alias("_day"))
    at_once = F.col("_day") == F.greatest("month_start", "start")
    return monthly.join(starts, "organization_id").select(
        "organization_id", "month_start", "__mrr", F.when(at_once, F.col("_top")).otherwise(F.greatest("_top", F.lit(0))).alias("_peak"))


# ------------------------------------------------------ business snapshot
def term_business_snapshot(b) -> DataFrame:
    """Org x month grid of pipeline, revenue, spend and usage with ratios and month-over-month growth.

    Movements of all kinds are stacked in integer cents and summed by
    (organisation, month) in one exchange, reduced before it.  The sums, at most
    a few rows per organisation and month, are then dealt by organisation, where
    the rest happens: they meet in one row, find names and budget, and the months
    without any are filled in.
    """
    as_of_month = F.trunc(F.lit(b.as_of).cast("date"), "MM")
    m0 = b.sessions.agg(F.trunc(F.min(F.to_date("started_at")), "MM")).scalar()  # scalar subquery
    o = dim_organizations(b).select("organization_id", "organization_name", "organization_status", "current_plan_name")
    s = fct_sessions(b)
    cell = ["organization_id", "month_start"]
    stack = lambda frames: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    rn = s.groupBy("organization_id", month_start("session_date").alias("month_start")).agg(
        F.count(F.lit(1)).alias("total_runs"), count_if(F.col("is_successful")).alias("successful_runs"),
        count_if(~F.col("is_successful")).alias("failed_runs"),
        F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("total_duration_seconds"),
        F.sum(F.coalesce("error_count", F.lit(0))).alias("total_errors"),
        F.sum(F.coalesce("event_count", F.lit(0))).alias("total_events"),
        F.bit_or(F.expr("shiftleft(1, day(session_date) - 1)")).alias("_days"),  # a bit for each day of the month
        F.sum(F.when(F.col("used_proxy"), 1).otherwise(0)).alias("sessions_with_proxy"),
        F.sum(F.when(F.col("is_stealth_mode"), 1).otherwise(0)).alias("sessions_with_stealth"),
        F.sum(F.nullif("pages_visited", F.lit(0))).alias("_pages"), F.count(F.nullif("pages_visited", F.lit(0))).alias("_paged"))
    acc = b.accounts.select("account_id", "organization_id")
    leads = (b.leads.select("account_id", month_start("created_at").alias("month_start"), F.when(F.col("lead_status") == "qualified", 1).otherwise(0).alias("_lead"))
             .join(acc, "account_id").drop("account_id"))
    cents = F.round(F.coalesce("amount_usd", F.lit(0.0)) * 100).cast("long")
    opp = b.account_opportunities(acc).withColumn("_won_at", F.when(F.col("stage") == "closed_won", F.col("closed_at")))
    deals = dated_measures(opp, [("created_at", {"_open": F.when(~F.col("stage").isin("closed_won", "closed_lost"), cents).otherwise(0)}),
                                 ("_won_at", {"_won": cents})], "MM", "month_start", ["organization_id"])
    spend = budget_facts(b).withColumnRenamed("month", "month_start")
    moved = stack([revenue_facts(b), spend, leads, deals]).groupBy(*cell).agg(
        *[F.sum(c).alias(c) for c in ("_paid", "_billed", *BUDGET_FACTS, "_open", "_won")],
        F.count("_lead").alias("new_leads"), F.sum("_lead").alias("qualified_leads"),
        F.count("_open").alias("new_opportunities"), F.count("_won").alias("won_opportunities"))
    # Numbers only; names come behind the last exchange.  gap_rows leaves out what is beyond the calendar: a filter
    # here would be pushed into the scans, and deals and card spends could no longer share the exchange of the lines.
    rows = stack([o.select("organization_id", m0.alias("month_start"), m0.alias("__start")), rn, monthly_mrr(b), moved])
    values = [c for c in rows.columns if c not in cell]
    sparse = rows.repartition("organization_id").groupBy(*cell).agg(*[F.max(c).alias(c) for c in values])
    own = [c for c in values if c not in ("__mrr", "__start")]
    names = ["organization_name", "organization_status", "current_plan_name"]
    known = sparse.join(o, "organization_id").join(department_budgets(b), "organization_id", "left")
    prior = ["_paid", "total_runs", "_card", "_reimb", "_bp"]

    def figures(x, mrr: Column) -> dict[str, Column]:
        z = lambda n, v=0: F.coalesce(x(n), F.lit(v))
        spent = {n: F.coalesce(e, F.lit(0.0)) for n, e in budget_columns(x).items()}
        runs, rev, total = z("total_runs"), z("_paid") / 100.0, spent["actual_spend_usd"]
        return {
            "new_leads": z("new_leads"), "qualified_leads": z("qualified_leads"),
            "new_opportunities": z("new_opportunities"), "won_opportunities": z("won_opportunities"),
            "pipeline_open_usd": z("_open") / 100.0, "won_revenue_usd": z("_won") / 100.0,
            "mrr_usd": F.coalesce(mrr / 100.0, F.lit(0.0)), "recognized_revenue_usd": rev,
            "gross_revenue_usd": z("_billed") / 100.0, "card_spend_usd": spent["card_spend_usd"],
            "reimbursement_spend_usd": spent["reimbursement_spend_usd"],
            "bill_payment_spend_usd": spent["bill_payment_spend_usd"],
            "total_spend_usd": total, "budget_allocated_usd": spent["budget_allocated_usd"],
            "budget_variance_usd": spent["budget_variance_usd"], "ap_open_usd": spent["ap_open_usd"],
            "total_runs": runs, "successful_runs": z("successful_runs"),
            "failed_runs": z("failed_runs"), "total_duration_seconds": z("total_duration_seconds"),
            "total_errors": z("total_errors"), "total_events": z("total_events"),
            "active_days_in_month": F.bit_count(z("_days")).cast("long"), "sessions_with_proxy": z("sessions_with_proxy"),
            "sessions_with_stealth": z("sessions_with_stealth"),
            "avg_pages_per_session": F.round(F.coalesce(safe_div(x("_pages"), x("_paged")), F.lit(0.0)), 4),
            "lead_to_opp_rate": safe_ratio(z("qualified_leads"), z("new_leads")),
            "opp_win_rate": safe_ratio(z("won_opportunities"), z("new_opportunities")),
            "success_rate_pct": safe_ratio(z("successful_runs"), runs),
            "avg_session_duration_seconds": safe_ratio(z("total_duration_seconds"), runs, 1.0),
            "revenue_per_run": safe_ratio(rev, runs, 1.0),
            "revenue_per_session": safe_ratio(rev, runs, 1.0),
            "gross_margin_proxy_usd": F.round(rev - total, 2),
            "gross_margin_proxy_pct": safe_ratio(rev - total, rev),
            "proxy_session_rate_pct": safe_ratio(z("sessions_with_proxy"), runs),
            "stealth_session_rate_pct": safe_ratio(z("sessions_with_stealth"), runs),
            "feature_adoption_rate": safe_ratio(z("sessions_with_proxy"), runs)}

    def growth(now: dict[str, Column], x) -> dict[str, Column]:
        def mom(col, before):
            prev = before.cast("double")  # an empty month before is a zero, like none
            return F.round((now[col].cast("double") - prev) / F.nullif(prev, F.lit(0.0)) * 100.0, 2)

        return {"mom_revenue_growth_pct": mom("recognized_revenue_usd", x("_paid") / 100.0),
                "mom_runs_growth_pct": mom("total_runs", x("total_runs")),
                "mom_spend_growth_pct": mom("total_spend_usd", sum(F.coalesce(x(n), F.lit(0)) for n in prior[2:]) / 100.0)}

    bare = without(known, own)
    made = {f"__fig_{n}": e for n, e in figures(F.col, F.col("__ahead___mrr") + F.coalesce("_peak", F.lit(0).cast("long"))).items()}
    c = gap_rows(known, "organization_id", "month_start", as_of_month, "MONTH", own=own, carried=["__mrr"], same=[*names, "_budget"],
                 before=prior, figures=made)
    empty = figures(bare, F.col("__upto___mrr"))
    told = {n: F.col(f"__fig_{n}") for n in empty}
    told_growth, after, empty_growth = growth(told, lambda n: F.col(f"__lag.{n}")), growth(empty, F.col), growth(empty, bare)
    copied = {n: F.col(n) for n in names}
    out = gap_spread(c, "organization_id", "month_start", "MONTH", {**copied, **told, **told_growth}, {**empty, **empty_growth}, after)
    return out.select("organization_id", *names, "month_start", F.last_day("month_start").alias("month_end"), *told, *told_growth)


# The highest MRR of a month is reached on its first day or where a subscription begins.
view("mrr_levels", f"""
WITH begun AS (SELECT organization_id, greatest(CAST(organization_created_at AS DATE), (SELECT min(date_day) FROM dim_time)) AS day0 FROM dim_organizations),
paid AS (SELECT organization_id, monthly_price_usd AS price, CAST(current_period_start AS DATE) AS a, CAST(ifnull(current_period_end, TIMESTAMP '2001-08-01') AS DATE) AS z
         FROM fct_subscriptions JOIN b_plans USING (plan_id) WHERE status = 'active' AND monthly_price_usd > 0),
asked AS (SELECT organization_id, greatest(day0, CAST(unnest(generate_series(date_trunc('month', day0), {AS_OF_SQL}, INTERVAL 1 MONTH)) AS DATE)) AS day FROM begun
          UNION SELECT organization_id, a FROM paid JOIN begun USING (organization_id) WHERE a BETWEEN day0 AND {AS_OF_SQL})
SELECT asked.organization_id, asked.day, ifnull(sum(price), 0.0) AS mrr
FROM asked LEFT JOIN paid ON paid.organization_id = asked.organization_id AND asked.day BETWEEN paid.a AND paid.z
GROUP BY ALL
""", "dim_organizations", "dim_time", "fct_subscriptions", "b_plans")

view("term_business_snapshot", f"""
WITH facts AS (
  SELECT organization_id, unnest(generate_series((SELECT min(month_start) FROM dim_time), DATE '2001-08-01', INTERVAL 1 MONTH)) AS happened_at,
         TRUE AS cell FROM dim_organizations
  UNION ALL BY NAME SELECT organization_id, session_date AS happened_at, session_date AS day, 1 AS run, is_successful AS ok, duration_seconds AS secs,
         error_count AS errs, event_count AS evs, used_proxy AS proxy, is_stealth_mode AS stealth, nullif(pages_visited, 0) AS pages FROM fct_sessions
  UNION ALL BY NAME SELECT organization_id, day AS happened_at, mrr FROM mrr_levels
  UNION ALL BY NAME SELECT organization_id, revenue_month AS happened_at, realized_revenue_usd AS realized, gross_revenue_usd AS gross FROM fin_monthly_revenue
  UNION ALL BY NAME SELECT organization_id, budget_month AS happened_at, card_spend_usd AS card, reimbursement_spend_usd AS own, bill_payment_spend_usd AS bill,
         actual_spend_usd AS spent, budget_allocated_usd AS plan, budget_variance_usd AS variance, ap_open_usd AS ap FROM fin_budget_vs_actual
  UNION ALL BY NAME SELECT organization_id, l.created_at AS happened_at, 1 AS lead, (lead_status = 'qualified')::INT AS good_lead
  FROM b_leads l JOIN b_accounts USING (account_id)
  UNION ALL BY NAME SELECT organization_id, o.created_at AS happened_at, 1 AS deal,
         if(starts_with(stage, 'closed_'), 0, CAST(round(ifnull(amount_usd, 0) * 100) AS BIGINT)) AS open_cents
  FROM b_opportunities o JOIN b_accounts USING (account_id)
  UNION ALL BY NAME SELECT organization_id, closed_at AS happened_at, 1 AS win, CAST(round(ifnull(amount_usd, 0) * 100) AS BIGINT) AS won_cents
  FROM b_opportunities JOIN b_accounts USING (account_id) WHERE stage = 'closed_won'),
months AS (
  SELECT organization_id, CAST(date_trunc('month', happened_at) AS DATE) AS month_start, count(lead) AS new_leads,
         count(*) FILTER (good_lead = 1) AS qualified_leads, count(deal) AS new_opportunities, count(win) AS won_opportunities,
         ifnull(sum(open_cents), 0) / 100.0 AS pipeline_open_usd, ifnull(sum(won_cents), 0) / 100.0 AS won_revenue_usd,
         ifnull(max(mrr), 0.0) AS mrr_usd, ifnull(max(realized), 0.0) AS recognized_revenue_usd, ifnull(max(gross), 0.0) AS gross_revenue_usd,
         ifnull(max(card), 0.0) AS card_spend_usd, ifnull(max(own), 0.0) AS reimbursement_spend_usd, ifnull(max(bill), 0.0) AS bill_payment_spend_usd,
         ifnull(max(spent), 0.0) AS total_spend_usd, ifnull(max(plan), 0.0) AS budget_allocated_usd, ifnull(max(variance), 0.0) AS budget_variance_usd,
         ifnull(max(ap), 0.0) AS ap_open_usd, count(run) AS total_runs, count(*) FILTER (ok) AS successful_runs, count(*) FILTER (NOT ok) AS failed_runs,
         CAST(ifnull(sum(secs), 0) AS BIGINT) AS total_duration_seconds, CAST(ifnull(sum(errs), 0) AS BIGINT) AS total_errors,
         CAST(ifnull(sum(evs), 0) AS BIGINT) AS total_events, count(DISTINCT day) AS active_days_in_month,
         count(*) FILTER (proxy) AS sessions_with_proxy, count(*) FILTER (stealth) AS sessions_with_stealth,
         round(ifnull(avg(pages), 0.0), 4) AS avg_pages_per_session
  FROM facts GROUP BY 1, 2 HAVING bool_or(cell)),
paired AS (
  SELECT m.*, p.recognized_revenue_usd AS revenue0, p.total_runs AS runs0, p.total_spend_usd AS spend0
  FROM months m LEFT JOIN months p ON p.organization_id = m.organization_id AND p.month_start = m.month_start - INTERVAL 1 MONTH)
SELECT paired.* EXCLUDE (revenue0, runs0, spend0), o.organization_name, o.organization_status, o.current_plan_name,
       CAST(month_start + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS month_end,
       round(100.0::DOUBLE * qualified_leads / nullif(new_leads, 0), 2) AS lead_to_opp_rate,
       round(100.0::DOUBLE * won_opportunities / nullif(new_opportunities, 0), 2) AS opp_win_rate,
       round(100.0::DOUBLE * successful_runs / nullif(total_runs, 0), 2) AS success_rate_pct,
       round(total_duration_seconds::DOUBLE / nullif(total_runs, 0), 2) AS avg_session_duration_seconds,
       round(recognized_revenue_usd / nullif(total_runs, 0), 2) AS revenue_per_run, round(recognized_revenue_usd / nullif(total_runs, 0), 2) AS revenue_per_session,
       round(recognized_revenue_usd - total_spend_usd, 2) AS gross_margin_proxy_usd,
       round((recognized_revenue_usd - total_spend_usd) / nullif(recognized_revenue_usd, 0) * 100, 2) AS gross_margin_proxy_pct,
       round(100.0::DOUBLE * sessions_with_proxy / nullif(total_runs, 0), 2) AS proxy_session_rate_pct,
       round(100.0::DOUBLE * sessions_with_stealth / nullif(total_runs, 0), 2) AS stealth_session_rate_pct,
       round(100.0::DOUBLE * sessions_with_proxy / nullif(total_runs, 0), 2) AS feature_adoption_rate,
       round((recognized_revenue_usd - revenue0) / nullif(revenue0, 0) * 100, 2) AS mom_revenue_growth_pct,
       round((total_runs - runs0)::DOUBLE / nullif(runs0, 0) * 100, 2) AS mom_runs_growth_pct,
       round((total_spend_usd - spend0) / nullif(spend0, 0) * 100, 2) AS mom_spend_growth_pct
FROM paired JOIN dim_organizations o USING (organization_id)
""", "dim_time", "dim_organizations", "fct_sessions", "mrr_levels", "fin_monthly_revenue", "fin_budget_vs_actual",
     "b_leads", "b_accounts", "b_opportunities")
register("term_business_snapshot", "SELECT * FROM term_business_snapshot", ("term_business_snapshot",),
         inputs=("dim_time", "dim_organizations", "fct_sessions", "fct_subscriptions", "fin_monthly_revenue",
                 "fin_budget_vs_actual", "stg_gtm_leads", "stg_gtm_accounts", "stg_gtm_opportunities"))(term_business_snapshot)


# ------------------------------------------------------------ exec daily
def _budget_by_month_end(b) -> DataFrame:
    bva = fin_budget_vs_actual(b)
    return bva.groupBy(F.last_day("budget_month").alias("metric_date")).agg(
        exact_sum("budget_allocated_usd", 2).alias("budget_allocated_usd"),
        exact_sum("actual_spend_usd", 2).alias("actual_spend_usd"),
        exact_sum("budget_variance_usd", 2).alias("budget_variance_usd"),
        F.round(100.0 * exact_sum("actual_spend_usd", 2) / F.nullif(exact_sum("budget_allocated_usd", 2), F.lit(0.0)), 2)
         .alias("budget_utilization_ratio"))


def term_exec_daily(b) -> DataFrame:
    g = gtm_growth_daily(b).select("metric_date", "total_sessions", "new_organizations", "new_users",
                                   "activation_rate_7d_pct")
    p = pro_product_daily(b).select("metric_date", "success_rate_pct", "proxy_adoption_pct", "stealth_adoption_pct")
    pl = gtm_pipeline_snapshot(b).select(F.col("as_of_date").alias("metric_date"), "open_pipeline_usd", "won_revenue_usd",
                                         "lead_conversion_rate_pct", "opportunity_win_rate_pct")
    m = fin_mrr(b).select(F.col("as_of_date").alias("metric_date"), "total_mrr_usd")
    bd = _budget_by_month_end(b)
    return _calendar_join([(g, "metric_date"), (p, "metric_date"), (pl, "metric_date"), (m, "metric_date"),
                           (bd, "metric_date")], "metric_date")


view("term_budget_daily", """
SELECT CAST(last_day(budget_month) AS DATE) AS metric_date,
       sum(CAST(round(budget_allocated_usd * 100) AS BIGINT)) / 100.0 AS budget_allocated_usd,
       sum(CAST(round(actual_spend_usd * 100) AS BIGINT)) / 100.0 AS actual_spend_usd,
       sum(CAST(round(budget_variance_usd * 100) AS BIGINT)) / 100.0 AS budget_variance_usd,
       round(100.0 * (sum(CAST(round(actual_spend_usd * 100) AS BIGINT)) / 100.0)
             / nullif(sum(CAST(round(budget_allocated_usd * 100) AS BIGINT)) / 100.0, 0), 2) AS budget_utilization_ratio
FROM fin_budget_vs_actual GROUP BY 1
""", "fin_budget_vs_actual")

view("term_exec_daily", """
SELECT metric_date, any_value(COLUMNS(* EXCLUDE (metric_date)))  -- every day has each figure from one source at most
FROM (SELECT metric_date, total_sessions, new_organizations, new_users, activation_rate_7d_pct FROM gtm_growth_daily
      UNION ALL BY NAME SELECT metric_date, success_rate_pct, proxy_adoption_pct, stealth_adoption_pct FROM pro_product_daily
      UNION ALL BY NAME SELECT as_of_date AS metric_date, open_pipeline_usd, won_revenue_usd, lead_conversion_rate_pct, opportunity_win_rate_pct
                        FROM gtm_pipeline_snapshot
      UNION ALL BY NAME SELECT as_of_date AS metric_date, total_mrr_usd FROM fin_mrr
      UNION ALL BY NAME SELECT metric_date, budget_allocated_usd, actual_spend_usd, budget_variance_usd, budget_utilization_ratio FROM term_budget_daily)
GROUP BY metric_date
""", "gtm_growth_daily", "pro_product_daily", "gtm_pipeline_snapshot", "fin_mrr", "term_budget_daily")
register("term_exec_daily", "SELECT * FROM term_exec_daily", ("term_exec_daily",),
         inputs=("gtm_growth_daily", "pro_product_daily", "gtm_pipeline_snapshot", "fin_mrr",
                 "fin_budget_vs_actual"))(term_exec_daily)


def term_gtm_daily(b) -> DataFrame:
    f = gtm_funnel_daily(b).select("metric_date", "leads_created", "qualified_leads_created", "leads_converted",
                                   "opportunities_created", "opportunities_closed_won",
                                   "opportunities_amount_created_usd", "closed_won_amount_usd")
    p = gtm_pipeline_snapshot(b).select(F.col("as_of_date").alias("metric_date"), "open_pipeline_usd", "won_revenue_usd",
                                        "lead_conversion_rate_pct", "opportunity_win_rate_pct", "leads_total",
                                        "opportunities_total")
    g = gtm_growth_daily(b).select("metric_date", "new_organizations", "new_users", "total_sessions")
    return _calendar_join([(f, "metric_date"), (p, "metric_date"), (g, "metric_date")], "metric_date")


view("term_gtm_daily", """
SELECT metric_date, any_value(COLUMNS(* EXCLUDE (metric_date)))
FROM (SELECT metric_date, leads_created, qualified_leads_created, leads_converted, opportunities_created, opportunities_closed_won,
             opportunities_amount_created_usd, closed_won_amount_usd FROM gtm_funnel_daily
      UNION ALL BY NAME SELECT as_of_date AS metric_date, open_pipeline_usd, won_revenue_usd, lead_conversion_rate_pct, opportunity_win_rate_pct,
                               leads_total, opportunities_total FROM gtm_pipeline_snapshot
      UNION ALL BY NAME SELECT metric_date, new_organizations, new_users, total_sessions FROM gtm_growth_daily)
GROUP BY metric_date
""", "gtm_funnel_daily", "gtm_pipeline_snapshot", "gtm_growth_daily")
register("term_gtm_daily", "SELECT * FROM term_gtm_daily", ("term_gtm_daily",),
         inputs=("gtm_funnel_daily", "gtm_pipeline_snapshot", "gtm_growth_daily"))(term_gtm_daily)


def term_product_daily(b) -> DataFrame:
    p = pro_product_daily(b).select("metric_date", "total_sessions", "success_rate_pct", "avg_duration_seconds",
                                    "proxy_adoption_pct", "stealth_adoption_pct")
    o = ops_daily(b).select("metric_date", F.col("total_sessions").alias("ops_total_sessions"), "total_gb_transferred",
                            F.col("avg_duration_seconds").alias("ops_avg_duration_seconds"), "proxy_session_pct")
    e = eng_daily(b).select("metric_date", "completed_sessions", "failed_sessions", "timeout_sessions",
                            F.col("success_rate_pct").alias("eng_success_rate_pct"), "timeout_rate_pct",
                            "errors_per_1k_sessions")
    return _calendar_join([(p, "metric_date"), (o, "metric_date"), (e, "metric_date")], "metric_date")


view("term_product_daily", """
SELECT metric_date, any_value(COLUMNS(* EXCLUDE (metric_date)))
FROM (SELECT metric_date, total_sessions, success_rate_pct, avg_duration_seconds, proxy_adoption_pct, stealth_adoption_pct FROM pro_product_daily
      UNION ALL BY NAME SELECT metric_date, total_sessions AS ops_total_sessions, total_gb_transferred, avg_duration_seconds AS ops_avg_duration_seconds,
                               proxy_session_pct FROM ops_daily
      UNION ALL BY NAME SELECT metric_date, completed_sessions, failed_sessions, timeout_sessions, success_rate_pct AS eng_success_rate_pct,
                               timeout_rate_pct, errors_per_1k_sessions FROM eng_daily)
GROUP BY metric_date
""", "pro_product_daily", "ops_daily", "eng_daily")
register("term_product_daily", "SELECT * FROM term_product_daily", ("term_product_daily",),
         inputs=("pro_product_daily", "ops_daily", "eng_daily"))(term_product_daily)


def term_finance_monthly(b) -> DataFrame:
    r = fin_monthly_revenue(b).groupBy(F.col("revenue_month").alias("metric_month")).agg(
        exact_sum("realized_revenue_usd", 2).alias("realized_revenue_usd"),
        exact_sum("pending_revenue_usd", 2).alias("pending_revenue_usd"),
        F.round(exact_avg("collection_rate_pct", 2), 6).alias("collection_rate_pct"),
        F.sum("open_invoice_count").alias("open_invoice_count"), F.sum("paid_invoice_count").alias("paid_invoice_count"))
    bva = fin_budget_vs_actual(b).groupBy(F.col("budget_month").alias("metric_month")).agg(
        exact_sum("budget_allocated_usd", 2).alias("budget_allocated_usd"),
        exact_sum("actual_spend_usd", 2).alias("actual_spend_usd"),
        exact_sum("budget_variance_usd", 2).alias("budget_variance_usd"),
        F.round(100.0 * exact_sum("actual_spend_usd", 2) / F.nullif(exact_sum("budget_allocated_usd", 2), F.lit(0.0)), 2)
         .alias("budget_utilization_ratio"),
        exact_sum("ap_open_usd", 2).alias("ap_open_usd"))
    s = fin_spend_monthly(b).groupBy(F.col("spend_month").alias("metric_month")).agg(
        exact_sum("spend_usd", 2).alias("total_spend_usd"), F.sum("record_count").alias("spend_record_count"))
    return _calendar_join([(r, "metric_month"), (bva, "metric_month"), (s, "metric_month")], "metric_month")


view("term_finance_monthly", """
WITH cents AS (  -- every amount of a month as (what, cents); shares and counts are amounts of their own
  SELECT revenue_month AS metric_month, unnest(['realized', 'pending', 'share', 'shares', 'open', 'paid']) AS what,
         unnest([CAST(round(realized_revenue_usd * 100) AS BIGINT), CAST(round(pending_revenue_usd * 100) AS BIGINT),
                 CAST(round(collection_rate_pct * 100) AS BIGINT), (collection_rate_pct IS NOT NULL)::BIGINT, open_invoice_count, paid_invoice_count]) AS n
  FROM fin_monthly_revenue
  UNION ALL
  SELECT budget_month, unnest(['plan', 'spent', 'variance', 'ap']),
         unnest([CAST(round(budget_allocated_usd * 100) AS BIGINT), CAST(round(actual_spend_usd * 100) AS BIGINT),
                 CAST(round(budget_variance_usd * 100) AS BIGINT), CAST(round(ap_open_usd * 100) AS BIGINT)]) FROM fin_budget_vs_actual
  UNION ALL
  SELECT spend_month, unnest(['out', 'records']), unnest([CAST(round(spend_usd * 100) AS BIGINT), record_count]) FROM fin_spend_monthly),
books AS (SELECT metric_month, map_from_entries(list((what, n))) AS b
          FROM (SELECT metric_month, what, CAST(sum(n) AS BIGINT) AS n FROM cents GROUP BY 1, 2) GROUP BY 1)
SELECT metric_month, b['realized'] / 100.0 AS realized_revenue_usd, b['pending'] / 100.0 AS pending_revenue_usd,
       round(b['share'] / 100.0 / nullif(b['shares'], 0), 6) AS collection_rate_pct, b['open'] AS open_invoice_count, b['paid'] AS paid_invoice_count,
       b['plan'] / 100.0 AS budget_allocated_usd, b['spent'] / 100.0 AS actual_spend_usd, b['variance'] / 100.0 AS budget_variance_usd,
       round(100.0 * (b['spent'] / 100.0) / nullif(b['plan'] / 100.0, 0), 2) AS budget_utilization_ratio, b['ap'] / 100.0 AS ap_open_usd,
       b['out'] / 100.0 AS total_spend_usd, b['records'] AS spend_record_count
FROM books
""", "fin_monthly_revenue", "fin_budget_vs_actual", "fin_spend_monthly")
register("term_finance_monthly", "SELECT * FROM term_finance_monthly", ("term_finance_monthly",),
         inputs=("fin_monthly_revenue", "fin_budget_vs_actual", "fin_spend_monthly"))(term_finance_monthly)


def term_customer_daily(b) -> DataFrame:
    risk = gtm_trial_risk(b).groupBy("organization_id", F.to_date("triggered_at").alias("metric_date")).agg(
        F.max("signal_score").alias("signal_score"), F.max("success_rate_7d").alias("success_rate_7d"),
        F.max("total_runs_7d").alias("total_runs_7d"), F.min("days_remaining_in_trial").alias("days_remaining_in_trial"))
    rm = fin_monthly_revenue(b).groupBy("organization_id", "revenue_month").agg(
        F.max("organization_name").alias("organization_name"), F.max("current_plan_name").alias("current_plan_name"),
        exact_sum("realized_revenue_usd", 2).alias("realized_revenue_usd"),
        exact_sum("pending_revenue_usd", 2).alias("pending_revenue_usd"),
        F.round(exact_avg("collection_rate_pct", 2), 6).alias("collection_rate_pct"))
    q = gtm_task_queue(b).groupBy("organization_id", F.to_date("created_at").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("queued_tasks"), count_if(F.col("priority") == "urgent").alias("urgent_tasks"))
    keys = ["organization_id", "metric_date"]
    cal = risk.select(*keys).unionByName(q.select(*keys)).distinct()
    j = (cal.join(risk, keys, "left").join(q, keys, "left")
         .withColumn("revenue_month", F.trunc("metric_date", "MM"))
         .join(rm, ["organization_id", "revenue_month"], "left"))
    return j.select("organization_id", "metric_date", "organization_name", "current_plan_name", "realized_revenue_usd",
                    "pending_revenue_usd", "collection_rate_pct", "signal_score", "success_rate_7d", "total_runs_7d",
                    "days_remaining_in_trial", "queued_tasks", "urgent_tasks")


view("term_customer_daily", """
WITH seen AS (
  SELECT organization_id, CAST(triggered_at AS DATE) AS metric_date, signal_score, success_rate_7d, total_runs_7d,
         days_remaining_in_trial, NULL AS priority FROM gtm_trial_risk
  UNION ALL BY NAME SELECT organization_id, CAST(created_at AS DATE) AS metric_date, priority FROM gtm_task_queue),
days AS (
  SELECT organization_id, metric_date, max(signal_score) AS signal_score, max(success_rate_7d) AS success_rate_7d,
         max(total_runs_7d) AS total_runs_7d, min(days_remaining_in_trial) AS days_remaining_in_trial,
         nullif(count(priority), 0) AS queued_tasks, if(count(priority) > 0, count(*) FILTER (priority = 'urgent'), NULL) AS urgent_tasks
  FROM seen GROUP BY ALL),
money AS (
  SELECT organization_id, revenue_month, max(organization_name) AS organization_name, max(current_plan_name) AS current_plan_name,
         sum(CAST(round(realized_revenue_usd * 100) AS BIGINT)) / 100.0 AS realized_revenue_usd,
         sum(CAST(round(pending_revenue_usd * 100) AS BIGINT)) / 100.0 AS pending_revenue_usd,
         round(sum(CAST(round(collection_rate_pct * 100) AS BIGINT)) / (100.0 * nullif(count(collection_rate_pct), 0)), 6) AS collection_rate_pct
  FROM fin_monthly_revenue GROUP BY ALL)
SELECT days.*, money.* EXCLUDE (organization_id, revenue_month)
FROM days LEFT JOIN money ON money.organization_id = days.organization_id AND month(revenue_month) = month(metric_date)
     AND year(revenue_month) = year(metric_date)
""", "gtm_trial_risk", "fin_monthly_revenue", "gtm_task_queue")
register("term_customer_daily", "SELECT * FROM term_customer_daily", ("term_customer_daily",),
         inputs=("gtm_trial_risk", "fin_monthly_revenue", "gtm_task_queue"))(term_customer_daily)


# ------------------------------------------------------------- scorecard
def term_scorecard(b) -> DataFrame:
    """Exactly one row of executive metrics: single-row aggregates attached together
    (zero rows if any input is empty, as in the source model)."""
    m = fin_mrr(b).select("as_of_date", "total_mrr_usd", "total_paying_customers", "arpu_usd")
    rev = fin_monthly_revenue(b)
    latest = rev.agg(F.max("revenue_month").alias("revenue_month"))
    r = (rev.join(latest, "revenue_month", "left_semi").groupBy("revenue_month").agg(
        exact_sum("realized_revenue_usd", 2).alias("realized_revenue_usd_latest_month"),
        F.when(exact_sum("gross_revenue_usd", 2) == 0, F.lit(0.0))
         .otherwise(F.round(100.0 * exact_sum("realized_revenue_usd", 2) / exact_sum("gross_revenue_usd", 2), 2))
         .alias("collection_rate_pct_latest_month"),
        F.sum("open_invoice_count").alias("open_invoice_count_latest_month")))
    p = gtm_pipeline_snapshot(b).select(F.col("as_of_date").alias("_p_as_of"), "open_pipeline_usd",
                                        "opportunity_win_rate_pct", "lead_conversion_rate_pct")
    f = (gtm_funnel_daily(b).filter(F.col("metric_date") >= F.date_sub(F.lit(b.as_of).cast("date"), 30))
         .agg(F.sum("leads_created").alias("leads_created_30d"),
              F.when(F.sum("leads_created") == 0, F.lit(0.0))
               .otherwise(F.round(100.0 * F.sum("opportunities_created") / F.sum("leads_created"), 2))
               .alias("lead_to_opp_rate_pct_30d")))
    e = eng_kpis(b).select("sessions_30d", "avg_success_rate_pct_30d", "avg_p95_duration_seconds_30d",
                           "avg_errors_per_1k_sessions_30d")
    j = attach_scalars(m, r, p, f, e)
    return j.select(F.coalesce("as_of_date", "_p_as_of", F.lit(b.as_of).cast("date")).alias("metric_date"),
                    "revenue_month", "total_mrr_usd", "total_paying_customers", "arpu_usd",
                    "realized_revenue_usd_latest_month", "collection_rate_pct_latest_month",
                    "open_invoice_count_latest_month", "open_pipeline_usd", "opportunity_win_rate_pct",
                    "lead_conversion_rate_pct", "leads_created_30d", "lead_to_opp_rate_pct_30d", "sessions_30d",
                    "avg_success_rate_pct_30d", "avg_p95_duration_seconds_30d", "avg_errors_per_1k_sessions_30d")


view("term_scorecard", f"""
SELECT coalesce(m.as_of_date, p.as_of_date, {AS_OF_SQL}) AS metric_date, m.total_mrr_usd, m.total_paying_customers, m.arpu_usd,
       money.*, p.open_pipeline_usd, p.opportunity_win_rate_pct, p.lead_conversion_rate_pct, recent.*,
       e.sessions_30d, e.avg_success_rate_pct_30d, e.avg_p95_duration_seconds_30d, e.avg_errors_per_1k_sessions_30d
FROM fin_mrr m POSITIONAL JOIN gtm_pipeline_snapshot p POSITIONAL JOIN eng_kpis e POSITIONAL JOIN (
  SELECT revenue_month, got / 100.0 AS realized_revenue_usd_latest_month,
         if(billed = 0, 0.0, round(100.0 * (got / 100.0) / (billed / 100.0), 2)) AS collection_rate_pct_latest_month,
         unpaid AS open_invoice_count_latest_month
  FROM (SELECT revenue_month, sum(CAST(round(realized_revenue_usd * 100) AS BIGINT)) AS got,
               sum(CAST(round(gross_revenue_usd * 100) AS BIGINT)) AS billed, CAST(sum(open_invoice_count) AS BIGINT) AS unpaid
        FROM fin_monthly_revenue GROUP BY 1 ORDER BY 1 DESC LIMIT 1)) money POSITIONAL JOIN (
  SELECT CAST(sum(leads_created) AS BIGINT) AS leads_created_30d,
         ifnull(round(100.0 * sum(opportunities_created) / nullif(sum(leads_created), 0), 2), 0.0) AS lead_to_opp_rate_pct_30d
  FROM gtm_funnel_daily WHERE date_diff('day', metric_date, {AS_OF_SQL}) <= 30) recent
""", "fin_mrr", "fin_monthly_revenue", "gtm_pipeline_snapshot", "gtm_funnel_daily", "eng_kpis")
register("term_scorecard", "SELECT * FROM term_scorecard", ("term_scorecard",),
         inputs=("fin_mrr", "fin_monthly_revenue", "gtm_pipeline_snapshot", "gtm_funnel_daily", "eng_kpis"))(term_scorecard)


def term_unit_economics(b) -> DataFrame:
    return fin_firm_unit_economics(b)


register("term_unit_economics", "SELECT * FROM fin_firm_ue", ("fin_firm_ue",),
         inputs=("fin_firm_unit_economics",))(term_unit_economics)
