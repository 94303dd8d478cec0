"""Finance data products: revenue, MRR, unit economics, billing reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, exact_avg, exact_sum, month_start, safe_div
from ..operators.shapes import bucketed_asof, bucketed_overlap, close_intervals, explode_months, latest_per_key
from .core import dim_organizations, fct_sessions
from .oracle_views import AS_OF_SQL, view
from .registry import register, stored_first

OPEN_END_TS = "2999-12-31 00:00:00"


def _open_end():
    return F.lit(OPEN_END_TS).cast("timestamp_ntz")


# ----------------------------------------------------- fin_monthly_revenue
def monthly_revenue(invoices: DataFrame, orgs: DataFrame) -> DataFrame:
    """Org x month invoice rollup; money summed in integer cents, divided once."""
    i = invoices.withColumn("revenue_month", month_start("period_start"))
    paid, opn, void = (F.col("invoice_status") == s for s in ("paid", "open", "void"))
    agg = i.groupBy("organization_id", "revenue_month").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        count_if(paid).alias("paid_invoice_count"),
        count_if(opn).alias("open_invoice_count"),
        count_if(void).alias("void_invoice_count"),
        F.sum(F.when(paid, F.col("total_cents")).otherwise(0)).alias("_realized"),
        F.sum(F.when(opn, F.col("total_cents")).otherwise(0)).alias("_pending"),
        F.sum("total_cents").alias("_gross"),
        F.sum(F.when(paid, F.col("tax_cents")).otherwise(0)).alias("_tax"),
        F.avg("total_cents").alias("_avg"))
    o = orgs.select("organization_id", "organization_name", "current_plan_name")
    j = agg.join(o, "organization_id", "left")
    return j.select(
        "organization_id", "revenue_month", "organization_name", "current_plan_name",
        "invoice_count", "paid_invoice_count", "open_invoice_count", "void_invoice_count",
        (F.col("_realized") / 100.0).alias("realized_revenue_usd"),
        (F.col("_pending") / 100.0).alias("pending_revenue_usd"),
        (F.col("_gross") / 100.0).alias("gross_revenue_usd"),
        (F.col("_tax") / 100.0).alias("tax_collected_usd"),
        F.round(F.col("_avg") / 100.0, 4).alias("avg_invoice_value_usd"),
        F.round(safe_div("_realized", "_gross") * 100.0, 2).alias("collection_rate_pct"))


@stored_first
def fin_monthly_revenue(b) -> DataFrame:
    return monthly_revenue(b.invoices, dim_organizations(b))


def revenue_amounts(b) -> DataFrame:
    """``fin_monthly_revenue`` for consumers that only need the amounts and the
    organisation name: same rows and values, without the current-plan lookup
    (no latest-subscription pick, no plan join)."""
    if "fin_monthly_revenue" in b.stored:
        return b.stored["fin_monthly_revenue"]
    orgs = b.organizations.select("organization_id", "organization_name",
                                  F.lit(None).cast("string").alias("current_plan_name"))
    return monthly_revenue(b.invoices, orgs)


def revenue_facts(b) -> DataFrame:
    """``organization_id, month_start`` and the cents paid and billed, unsummed."""
    if "fin_monthly_revenue" in b.stored:  # a row per month and row of the organisation
        rows = b.stored["fin_monthly_revenue"].groupBy("organization_id", F.col("revenue_month").alias("month_start")).agg(
            F.max("realized_revenue_usd").alias("p"), F.max("gross_revenue_usd").alias("g"))
        return rows.select("organization_id", "month_start", *[F.round(F.col(c) * 100).cast("long").alias(n) for c, n in (("p", "_paid"), ("g", "_billed"))])
    return b.invoices.select("organization_id", month_start("period_start").alias("month_start"),
                             F.when(F.col("invoice_status") == "paid", F.col("total_cents")).otherwise(0).alias("_paid"), F.col("total_cents").alias("_billed"))


view("fin_monthly_revenue", """
WITH by_status AS (  -- one row per organisation, month and invoice status
  SELECT organization_id, CAST(period_start AS DATE) - (day(period_start) - 1)::INT AS revenue_month, invoice_status AS s, count(*) AS n,
         count(total_cents) AS priced, sum(total_cents) AS cents, sum(tax_cents) AS tax FROM b_invoices GROUP BY ALL),
folded AS (
  SELECT organization_id, revenue_month, CAST(sum(n) AS BIGINT) AS invoice_count, CAST(ifnull(sum(n) FILTER (s = 'paid'), 0) AS BIGINT) AS paid_invoice_count,
         CAST(ifnull(sum(n) FILTER (s = 'open'), 0) AS BIGINT) AS open_invoice_count, CAST(ifnull(sum(n) FILTER (s = 'void'), 0) AS BIGINT) AS void_invoice_count,
         ifnull(sum(cents) FILTER (s = 'paid'), 0) AS got, ifnull(sum(cents) FILTER (s = 'open'), 0) AS due, sum(cents) AS billed,
         ifnull(sum(tax) FILTER (s = 'paid'), 0) AS tax, sum(priced) AS priced FROM by_status GROUP BY ALL)
SELECT folded.* EXCLUDE (got, due, billed, tax, priced) REPLACE (CAST(revenue_month AS DATE) AS revenue_month),
       (SELECT any_value(organization_name) FROM dim_organizations d WHERE d.organization_id = folded.organization_id) AS organization_name,
       (SELECT any_value(current_plan_name) FROM dim_organizations d WHERE d.organization_id = folded.organization_id) AS current_plan_name,
       got / 100.0 AS realized_revenue_usd, due / 100.0 AS pending_revenue_usd, billed / 100.0 AS gross_revenue_usd, tax / 100.0 AS tax_collected_usd,
       round(billed / priced / 100.0, 4) AS avg_invoice_value_usd, round(100 * got::DOUBLE / nullif(billed::DOUBLE, 0), 2) AS collection_rate_pct
FROM folded
""", "b_invoices", "dim_organizations")
register("fin_monthly_revenue", "SELECT * FROM fin_monthly_revenue", ("fin_monthly_revenue",),
         inputs=("stg_invoices", "dim_organizations"))(fin_monthly_revenue)


# ------------------------------------------------------------------ fin_mrr
PAID_PLANS = ("starter", "pro", "enterprise")


def mrr_snapshot(subs: DataFrame, plans: DataFrame, orgs: DataFrame, as_of: str) -> DataFrame:
    a = subs.filter(F.col("status") == "active").select("organization_id", "plan_id")
    p = F.broadcast(plans.select("plan_id", "plan_name", "monthly_price_usd"))  # bounded plan catalogue
    o = orgs.filter(F.col("status") == "active").select("organization_id")
    j = (a.join(p, "plan_id").join(o, "organization_id", "left_semi")
         .filter(F.col("monthly_price_usd") > 0))
    price, plan, org = F.col("monthly_price_usd"), F.col("plan_name"), F.col("organization_id")
    aggs = [F.lit(as_of).cast("date").alias("as_of_date"), F.sum(price).alias("total_mrr_usd")]
    aggs += [F.sum(F.when(plan == n, price).otherwise(0.0)).alias(f"{n}_mrr_usd") for n in PAID_PLANS]
    aggs += [F.countDistinct(org).alias("total_paying_customers")]
    aggs += [F.countDistinct(F.when(plan == n, org)).alias(f"{n}_customers") for n in PAID_PLANS]
    aggs += [F.round(F.sum(price) / F.nullif(F.countDistinct(org), F.lit(0)), 2).alias("arpu_usd")]
    return j.agg(*aggs)


def fin_mrr(b) -> DataFrame:
    return mrr_snapshot(b.subscriptions, b.plans, b.organizations, b.as_of)


view("fin_mrr", f"""
WITH payers AS (  -- one row per organisation and paid plan, with the number of its subscriptions
  SELECT organization_id, plan_id, count(*) AS n FROM b_subscriptions
  WHERE status = 'active' AND organization_id IN (SELECT organization_id FROM b_organizations WHERE status = 'active') GROUP BY ALL),
priced AS (SELECT organization_id, plan_name, n * monthly_price_usd AS usd FROM payers, b_plans WHERE b_plans.plan_id = payers.plan_id AND monthly_price_usd > 0),
plans AS (SELECT plan_name, sum(usd) AS usd, count(DISTINCT organization_id) AS customers FROM priced GROUP BY GROUPING SETS ((plan_name), ()))
SELECT {AS_OF_SQL} AS as_of_date, max(usd) FILTER (plan_name IS NULL) AS total_mrr_usd,
       if(count(plan_name) = 0, NULL, ifnull(max(usd) FILTER (plan_name = 'starter'), 0)) AS starter_mrr_usd,
       if(count(plan_name) = 0, NULL, ifnull(max(usd) FILTER (plan_name = 'pro'), 0)) AS pro_mrr_usd,
       if(count(plan_name) = 0, NULL, ifnull(max(usd) FILTER (plan_name = 'enterprise'), 0)) AS enterprise_mrr_usd,
       max(customers) FILTER (plan_name IS NULL) AS total_paying_customers,
       ifnull(max(customers) FILTER (plan_name = 'starter'), 0) AS starter_customers, ifnull(max(customers) FILTER (plan_name = 'pro'), 0) AS pro_customers,
       ifnull(max(customers) FILTER (plan_name = 'enterprise'), 0) AS enterprise_customers,
       round(max(usd / nullif(customers, 0)) FILTER (plan_name IS NULL), 2) AS arpu_usd
FROM plans
""", "b_subscriptions", "b_plans", "b_organizations")
register("fin_mrr", "SELECT * FROM fin_mrr", ("fin_mrr",),
         inputs=("stg_subscriptions", "stg_plans", "stg_organizations"))(fin_mrr)


# ---------------------------------------------------- subscription history
def subscription_history(subs: DataFrame, plans: DataFrame) -> DataFrame:
    """Closed, non-overlapping subscription intervals per organisation.

    effective_end = least(raw end, next start - 1 second); the next start is
    taken in (start, subscription_id) order, so same-instant starts close the
    earlier one before it opens (it then matches nothing).
    """
    p = F.broadcast(plans.select("plan_id", "plan_name", "sessions_limit_monthly", "max_session_duration_mins"))
    base = (subs.join(p, "plan_id", "left")
            .select("organization_id", "subscription_id", "plan_id", "plan_name", "sessions_limit_monthly",
                    "max_session_duration_mins",
                    F.coalesce("current_period_start", "created_at").alias("effective_start_ts"),
                    F.coalesce(F.col("current_period_end"), _open_end()).alias("raw_end_ts")))
    return close_intervals(base, ["organization_id"], "effective_start_ts", "raw_end_ts",
                           [("effective_start_ts", "asc"), ("subscription_id", "asc")],
                           "INTERVAL 1 SECOND", "effective_end_ts")


view("begun", """
SELECT organization_id, subscription_id, plan_id, ifnull(current_period_start, created_at) AS since,
       ifnull(current_period_end, TIMESTAMP '2999-12-31 00:00:00') AS till
FROM b_subscriptions
""", "b_subscriptions")

view("sub_history", """
SELECT s.organization_id, s.subscription_id, s.plan_id, p.plan_name, p.sessions_limit_monthly, p.max_session_duration_mins,
       s.since AS effective_start_ts, s.till AS raw_end_ts,
       list_min([s.till, (SELECT min(later.since) FROM begun later WHERE later.organization_id = s.organization_id
                          AND (later.since, later.subscription_id) > (s.since, s.subscription_id)) - INTERVAL 1 SECOND]) AS effective_end_ts
FROM begun s LEFT JOIN b_plans p USING (plan_id)
""", "begun", "b_plans")


@stored_first
def fin_subscription_history(b) -> DataFrame:
    return subscription_history(b.subscriptions, b.plans)


register("fin_subscription_history", "SELECT * FROM sub_history", ("sub_history",),
         inputs=("stg_subscriptions", "stg_plans"))(fin_subscription_history)


# -------------------------------------------- fin_customer_unit_economics
def _cost_ranges(plan_econ: DataFrame) -> DataFrame:
    """Per plan, the (bounded) list of cost ranges, to be broadcast."""
    return plan_econ.groupBy("plan_id").agg(
        F.collect_list(F.struct(F.col("effective_start").alias("s"),
                                F.coalesce(F.col("effective_end"), _open_end()).alias("e"),
                                F.col("expected_cost_per_hour_usd").alias("c"))).alias("_ranges"))


REVENUE = ("realized_revenue_usd", "pending_revenue_usd", "gross_revenue_usd")


def customer_unit_economics(sessions: DataFrame, subs: DataFrame, plans: DataFrame, plan_econ: DataFrame,
                            revenue: DataFrame, orgs: DataFrame) -> DataFrame:
    """Org x month usage cost vs realised revenue vs pro-rated entitlement.

    * each session is matched to the subscription interval containing it
      (as-of), via an equi-join on (org, month) against month-exploded closed
      intervals; intervals are disjoint so at most one matches;
    * the cost per hour is the latest-starting plan cost range containing the
      session, picked per row from the broadcast (bounded) range list;
    * entitlements are summed over interval slices overlapping each month.
    """
    hist = subscription_history(subs, plans)

    ts = F.coalesce("started_at", "created_at")
    sb = (sessions.filter(ts.isNotNull() & F.col("duration_seconds").isNotNull() & (F.col("duration_seconds") > 0))
          .select("session_id", "organization_id", ts.alias("session_ts"),
                  month_start(ts).alias("metric_month"), F.col("duration_seconds")))
    matched = bucketed_asof(sb, hist, "organization_id", "session_ts", "effective_start_ts", "effective_end_ts",
                            ["plan_id", "plan_name"])
    ranges = F.broadcast(_cost_ranges(plan_econ))  # one row per plan: bounded config
    enriched = (matched.join(ranges, "plan_id", "left")
                .withColumn("_hits", F.filter("_ranges", lambda r: (r["s"] <= F.col("session_ts"))
                                               & (F.col("session_ts") < r["e"])))
                .withColumn("cost_per_hour", F.array_max(F.transform("_hits", lambda r: F.struct(r["s"], r["c"])))["c"])
                .drop("_ranges", "_hits"))
    # Cost in integer (seconds x cents-per-hour) units, divided once: order-independent sums.
    cost_units = F.col("duration_seconds").cast("long") * F.round(F.coalesce("cost_per_hour", F.lit(0.0)) * 100).cast("long")
    by_plan = enriched.groupBy("organization_id", "metric_month", "plan_name").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration_seconds").alias("_secs"), F.sum(cost_units).alias("_units"),
        count_if(F.col("cost_per_hour").isNull()).alias("_missing"))
    # Usage by plan and revenue are stacked and folded once: one row per organisation and month of either.
    stacked = by_plan.unionByName(revenue.select(
        "organization_id", F.col("revenue_month").alias("metric_month"), F.col("organization_name").alias("rev_org_name"),
        *[F.col(c) for c in REVENUE]), allowMissingColumns=True)
    most = F.struct(-F.col("_n"), F.col("plan_name").isNull(), "plan_name")
    spine = stacked.groupBy("organization_id", "metric_month").agg(
        F.sum("_n").alias("sessions_with_duration"), (F.sum("_secs") / 3600.0).alias("total_session_hours"),
        (F.sum("_units") / 360000.0).alias("expected_cost_usd"), F.sum("_missing").alias("sessions_missing_cost_assumption"),
        F.min(F.when(F.col("_n").isNotNull(), most))["plan_name"].alias("primary_plan_name"),
        F.max("rev_org_name").alias("rev_org_name"), *[F.sum(c).alias(c) for c in REVENUE])

    # Open intervals reach to the last month that has usage or revenue.
    last = F.greatest(sb.agg(F.max("metric_month")).scalar(), revenue.agg(F.max("revenue_month")).scalar())
    hist_m = explode_months(hist, "effective_start_ts", "effective_end_ts", last)
    # Entitlement slices: an interval's share of every month it touches.
    sl = hist_m.select("organization_id", F.col("bucket_month").alias("metric_month"), "sessions_limit_monthly", "max_session_duration_mins",
                       F.col("effective_start_ts").alias("_hs"), F.col("effective_end_ts").alias("_he"),
                       F.col("bucket_month").cast("timestamp_ntz").alias("_ms"),
                       (F.date_add(F.last_day("bucket_month"), 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND")).alias("_me"),
                       (F.datediff(F.last_day("bucket_month"), F.col("bucket_month")) + 1).alias("_days"))
    sl = sl.filter((F.col("_hs") <= F.col("_me")) & (F.col("_he") >= F.col("_ms")))
    o_s, o_e = F.greatest("_hs", "_ms"), F.least("_he", "_me")
    ov_days = (F.datediff(F.to_date(o_e), F.to_date(o_s)) + 1).cast("double")
    lim = F.col("sessions_limit_monthly")
    ent_s = (F.when(lim.isNull(), F.lit(None).cast("double")).when(o_e < o_s, F.lit(0.0))
             .otherwise(lim * ov_days / F.nullif(F.col("_days"), F.lit(0))))
    ent_h = (F.when(lim.isNull(), F.lit(None).cast("double"))
             .when(F.col("max_session_duration_mins").isNull(), F.lit(None).cast("double"))
             .when(o_e < o_s, F.lit(0.0))
             .otherwise(lim * (F.col("max_session_duration_mins") / 60.0) * ov_days / F.nullif(F.col("_days"), F.lit(0))))
    se = sl.groupBy("organization_id", "metric_month").agg(
        F.sum(ent_s).alias("entitled_sessions_monthly_prorated"),
        F.sum(ent_h).alias("_ent_h"),
        F.max(F.when(lim.isNull(), 1).otherwise(0)).alias("_unl"))

    keys = ["organization_id", "metric_month"]
    o = orgs.select("organization_id", F.col("organization_name").alias("_oname"))
    f = spine.join(se, keys, "left").join(o, "organization_id", "left")
    cost = F.coalesce("expected_cost_usd", F.lit(0.0))
    n = F.coalesce("sessions_with_duration", F.lit(0))
    hours = F.coalesce("total_session_hours", F.lit(0.0))
    rev = F.coalesce("realized_revenue_usd", F.lit(0.0))
    ent_hours = F.when(F.coalesce("_unl", F.lit(1)) == 1, F.lit(None).cast("double")).otherwise(F.col("_ent_h"))
    return f.select(
        "organization_id", F.coalesce("rev_org_name", "_oname").alias("organization_name"), "metric_month",
        "primary_plan_name", n.alias("sessions_with_duration"), F.round(hours, 6).alias("total_session_hours"),
        F.round(cost, 6).alias("expected_cost_usd"),
        F.coalesce("sessions_missing_cost_assumption", F.lit(0)).alias("sessions_missing_cost_assumption"),
        "realized_revenue_usd", "pending_revenue_usd", "gross_revenue_usd",
        F.round("entitled_sessions_monthly_prorated", 4).alias("entitled_sessions_monthly_prorated"),
        F.round(ent_hours, 4).alias("entitled_hours_monthly_prorated"),
        F.round(cost / F.nullif(n.cast("double"), F.lit(0.0)), 4).alias("expected_cost_per_session_usd"),
        F.round(cost / F.nullif(hours, F.lit(0.0)), 4).alias("blended_expected_cost_per_hour_usd"),
        F.round(rev - cost, 2).alias("gross_margin_usd"),
        F.round((rev - cost) / F.nullif(rev, F.lit(0.0)) * 100.0, 2).alias("gross_margin_pct"),
        F.round(hours / F.nullif(ent_hours, F.lit(0.0)) * 100.0, 2).alias("utilization_pct"))


def fin_customer_unit_economics(b) -> DataFrame:
    return customer_unit_economics(b.sessions, b.subscriptions, b.plans, b.plan_economics,
                                   revenue_amounts(b), b.organizations)


view("cue_priced", """
WITH used AS (SELECT organization_id, ifnull(started_at, created_at) AS happened_at, duration_seconds AS secs FROM b_sessions
              WHERE duration_seconds > 0 AND ifnull(started_at, created_at) IS NOT NULL),
planned AS (  -- the latest interval begun by then, if it still runs
  SELECT u.*, if(u.happened_at <= h.effective_end_ts, h.plan_id, NULL) AS plan_id, if(u.happened_at <= h.effective_end_ts, h.plan_name, NULL) AS plan_name
  FROM used u ASOF LEFT JOIN (SELECT * FROM sub_history WHERE effective_end_ts >= effective_start_ts) h
    ON u.organization_id = h.organization_id AND u.happened_at >= h.effective_start_ts)
SELECT x.organization_id, CAST(date_trunc('month', x.happened_at) AS DATE) AS metric_month, x.plan_name, x.secs,
       if(c.effective_end IS NULL OR x.happened_at < c.effective_end, c.expected_cost_per_hour_usd, NULL) AS rate
FROM planned x ASOF LEFT JOIN b_plan_economics c ON x.plan_id = c.plan_id AND x.happened_at >= c.effective_start
""", "b_sessions", "sub_history", "b_plan_economics")

view("cue_months", """
SELECT organization_id, metric_month, sum(n) AS n, sum(secs) / 3600.0 AS hours, sum(units) / 360000.0 AS cost, sum(unpriced) AS unpriced,
       first(plan_name ORDER BY n DESC, plan_name NULLS LAST) FILTER (n > 0) AS plan, max(name) AS name, max(got) AS got,
       max(due) AS due, max(billed) AS billed
FROM (SELECT organization_id, metric_month, plan_name, count(*) AS n, sum(secs) AS secs, count(*) FILTER (rate IS NULL) AS unpriced,
             sum(secs::BIGINT * CAST(round(ifnull(rate, 0) * 100) AS BIGINT)) AS units FROM cue_priced GROUP BY ALL
      UNION ALL BY NAME
      SELECT organization_id, revenue_month AS metric_month, max(organization_name) AS name, sum(realized_revenue_usd) AS got,
             sum(pending_revenue_usd) AS due, sum(gross_revenue_usd) AS billed, 0 AS n FROM fin_monthly_revenue GROUP BY ALL)
GROUP BY 1, 2
""", "cue_priced", "fin_monthly_revenue")

view("cue_rights", """
WITH held AS (SELECT organization_id, list({'a': effective_start_ts, 'z': effective_end_ts, 'cap': sessions_limit_monthly,
                                            'mins': max_session_duration_mins}) AS hs FROM sub_history GROUP BY 1),
open_in AS (
  SELECT m.organization_id, m.metric_month, day(last_day(m.metric_month)) AS days, m.metric_month::TIMESTAMP AS m0,
         m.metric_month + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS m1, held.hs
  FROM cue_months m LEFT JOIN held USING (organization_id)),
parts AS (
  SELECT organization_id, metric_month, days,
         [{'cap': h.cap, 'mins': h.mins, 'n': if(least(h.z, m1) < greatest(h.a, m0), 0, date_diff('day', CAST(greatest(h.a, m0) AS DATE), CAST(least(h.z, m1) AS DATE)) + 1)}
          for h in ifnull(hs, []) if h.a <= m1 AND h.z >= m0] AS ps FROM open_in)
SELECT organization_id, metric_month, list_sum([p.cap * p.n::DOUBLE / days for p in ps]) AS sessions,
       list_sum([(p.cap * (p.mins / 60.0)) * p.n::DOUBLE / days for p in ps]) AS hours,
       len(ps) = 0 OR list_bool_or([p.cap IS NULL for p in ps]) AS unlimited
FROM parts
""", "cue_months", "sub_history")

view("fin_cue", """
WITH full_month AS (
  SELECT m.*, r.sessions AS right_sessions, if(r.unlimited, NULL, r.hours) AS right_hours, ifnull(m.hours, 0) AS h, ifnull(m.cost, 0) AS c,
         ifnull(m.got, 0) AS g, ifnull(m.name, o.organization_name) AS who
  FROM cue_months m JOIN cue_rights r USING (organization_id, metric_month) LEFT JOIN b_organizations o USING (organization_id))
SELECT organization_id, who AS organization_name, metric_month, plan AS primary_plan_name, CAST(n AS BIGINT) AS sessions_with_duration,
       round(h, 6) AS total_session_hours, round(c, 6) AS expected_cost_usd,
       CAST(ifnull(unpriced, 0) AS BIGINT) AS sessions_missing_cost_assumption, got AS realized_revenue_usd,
       due AS pending_revenue_usd, billed AS gross_revenue_usd, round(right_sessions, 4) AS entitled_sessions_monthly_prorated,
       round(right_hours, 4) AS entitled_hours_monthly_prorated, round(c / nullif(n, 0), 4) AS expected_cost_per_session_usd,
       round(c / nullif(h, 0), 4) AS blended_expected_cost_per_hour_usd, round(g - c, 2) AS gross_margin_usd,
       round((g - c) / nullif(g, 0) * 100, 2) AS gross_margin_pct, round(h / nullif(right_hours, 0) * 100, 2) AS utilization_pct
FROM full_month
""", "cue_months", "cue_rights", "b_organizations")

register("fin_customer_unit_economics", "SELECT * FROM fin_cue", ("fin_cue",),
         inputs=("fct_sessions", "stg_subscriptions", "stg_plans", "stg_plan_economics",
                 "fin_monthly_revenue", "stg_organizations"))(fin_customer_unit_economics)


# ----------------------------------------------- fin_firm_unit_economics
def firm_unit_economics(cue: DataFrame) -> DataFrame:
    r = cue.groupBy("metric_month").agg(
        F.countDistinct("organization_id").alias("customer_count"),
        F.countDistinct(F.when(F.col("sessions_with_duration") > 0, F.col("organization_id"))).alias("active_customer_count"),
        F.sum("sessions_with_duration").alias("total_sessions_with_duration"),
        exact_sum("total_session_hours", 6).alias("_hours"),
        exact_sum("expected_cost_usd", 6).alias("_cost"),
        exact_sum(F.coalesce("realized_revenue_usd", F.lit(0.0)), 2).alias("_rev"),
        exact_sum(F.coalesce("entitled_hours_monthly_prorated", F.lit(0.0)), 4).alias("_ent"),
        exact_avg("utilization_pct", 2).alias("_avg_util"))
    return r.select(
        "metric_month", "customer_count", "active_customer_count", "total_sessions_with_duration",
        F.round("_hours", 4).alias("total_session_hours"), F.round("_cost", 4).alias("total_expected_cost_usd"),
        F.round("_rev", 2).alias("total_realized_revenue_usd"),
        F.round(F.col("_rev") - F.col("_cost"), 2).alias("gross_margin_usd"),
        F.round((F.col("_rev") - F.col("_cost")) / F.nullif(F.col("_rev"), F.lit(0.0)) * 100.0, 2).alias("gross_margin_pct"),
        F.round(F.col("_cost") / F.nullif(F.col("_hours"), F.lit(0.0)), 4).alias("blended_expected_cost_per_hour_usd"),
        F.round("_ent", 4).alias("total_entitled_hours_prorated"),
        F.round(F.col("_hours") / F.nullif(F.col("_ent"), F.lit(0.0)) * 100.0, 2).alias("utilization_pct"),
        F.round("_avg_util", 2).alias("avg_customer_utilization_pct"))


def fin_firm_unit_economics(b) -> DataFrame:
    return firm_unit_economics(fin_customer_unit_economics(b))


view("fin_firm_ue", """
SELECT metric_month, customer_count, active_customer_count, total_sessions_with_duration,
       round(h, 4) AS total_session_hours, round(c, 4) AS total_expected_cost_usd,
       round(r, 2) AS total_realized_revenue_usd, round(r - c, 2) AS gross_margin_usd,
       round((r - c) / nullif(r, 0) * 100, 2) AS gross_margin_pct,
       round(c / nullif(h, 0), 4) AS blended_expected_cost_per_hour_usd,
       round(e, 4) AS total_entitled_hours_prorated, round(h / nullif(e, 0) * 100, 2) AS utilization_pct,
       round(u, 2) AS avg_customer_utilization_pct
FROM (SELECT metric_month, count(DISTINCT organization_id) AS customer_count,
             count(DISTINCT CASE WHEN sessions_with_duration > 0 THEN organization_id END) AS active_customer_count,
             CAST(sum(sessions_with_duration) AS BIGINT) AS total_sessions_with_duration,
             sum(CAST(round(total_session_hours * 1000000) AS BIGINT)) / 1000000.0 AS h,
             sum(CAST(round(expected_cost_usd * 1000000) AS BIGINT)) / 1000000.0 AS c,
             sum(CAST(round(coalesce(realized_revenue_usd, 0) * 100) AS BIGINT)) / 100.0 AS r,
             sum(CAST(round(CASE WHEN entitled_hours_monthly_prorated IS NOT NULL THEN entitled_hours_monthly_prorated
                                 ELSE 0 END * 10000) AS BIGINT)) / 10000.0 AS e,
             sum(CAST(round(utilization_pct * 100) AS BIGINT)) / 100.0 / nullif(count(utilization_pct), 0) AS u
      FROM fin_cue GROUP BY 1)
""", "fin_cue")
register("fin_firm_unit_economics", "SELECT * FROM fin_firm_ue", ("fin_firm_ue",),
         inputs=("fin_customer_unit_economics",))(fin_firm_unit_economics)


# ------------------------------------------------ fin_usage_billing_export
def _day_history(subs: DataFrame, plans: DataFrame) -> DataFrame:
    p = F.broadcast(plans.select("plan_id", "plan_name", "sessions_limit_monthly"))
    base = (subs.join(p, "plan_id", "left")
            .select("organization_id", "subscription_id", "plan_name", "sessions_limit_monthly",
                    F.to_date(F.coalesce("current_period_start", "created_at")).alias("effective_start_date"),
                    F.to_date(F.coalesce(F.col("current_period_end"), _open_end())).alias("raw_end_date")))
    return close_intervals(base, ["organization_id"], "effective_start_date", "raw_end_date",
                           [("effective_start_date", "asc"), ("subscription_id", "asc")],
                           "INTERVAL 1 DAY", "effective_end_date")


def usage_billing_export(usage: DataFrame, orgs: DataFrame, subs: DataFrame, plans: DataFrame,
                         sessions: DataFrame) -> DataFrame:
    """Per billing period: ledger sessions, entitlement pro-rated across plan
    changes, corrected overage vs the naive current-plan overage, and the
    leakage between them."""
    bp = usage.groupBy("organization_id", "period_start", "period_end").agg(
        F.max("sessions_count").alias("recorded_sessions_count"),
        F.max("session_minutes").alias("recorded_session_minutes"),
        F.max("bytes_downloaded").alias("recorded_bytes_downloaded"),
        F.max("bytes_uploaded").alias("recorded_bytes_uploaded"),
        F.max("proxy_requests").alias("recorded_proxy_requests"))
    pk = ["organization_id", "period_start", "period_end"]

    start = F.coalesce("current_period_start", "created_at")
    cur = latest_per_key(
        subs.select("organization_id", "subscription_id", "plan_id", start.alias("_k1"), F.col("created_at").alias("_k2")),
        ["organization_id"], [("_k1", "desc"), ("_k2", "desc"), ("subscription_id", "desc")])
    pl = F.broadcast(plans.select("plan_id", "plan_name", "sessions_limit_monthly"))  # bounded catalogue
    oc = (orgs.select("organization_id", "organization_name", "billing_email")
          .join(cur.select("organization_id", F.to_date("_k1").alias("_cur_start"), "plan_id"), "organization_id", "left")
          .join(pl, "plan_id", "left")
          .select("organization_id", "organization_name", "billing_email", "_cur_start",
                  F.col("plan_id").alias("current_plan_id"), F.col("plan_name").alias("current_plan_name"),
                  F.col("sessions_limit_monthly").alias("current_plan_sessions_limit")))
    sold = bp.join(oc, "organization_id", "left").withColumn("_lo", F.greatest("period_start", F.coalesce("_cur_start", "period_start")))

    hist = _day_history(subs, plans)
    # Interval overlap as an equi-join on (org, first common month): exact, one candidate per overlapping pair.
    sl = bucketed_overlap(bp, hist, "organization_id", "period_start", "period_end", "effective_start_date",
                          "effective_end_date", ["subscription_id", "sessions_limit_monthly"])
    o_s = F.greatest("period_start", "effective_start_date")
    o_e = F.least("period_end", "effective_end_date")
    pdays = F.datediff("period_end", "period_start") + 1
    lim = F.col("sessions_limit_monthly")
    ent = (F.when(o_e < o_s, F.lit(0.0)).when(lim.isNull(), F.lit(None).cast("double"))
           .otherwise(lim * (F.datediff(o_e, o_s) + 1).cast("double") / F.nullif(pdays, F.lit(0))))
    pe_matched = sl.groupBy(*pk).agg(F.sum(ent).alias("corrected_entitled_sessions"),
                                     F.max(F.when(lim.isNull(), 1).otherwise(0)).alias("has_unlimited_slice"))

    # Sessions pre-aggregated to (org, day) counts meet their periods on (org, month) + range, once for both counts:
    # those of the period, and those since the current plan began.
    daily = (sessions.groupBy(F.col("organization_id").alias("_org"), F.to_date("created_at").alias("_d"))
             .agg(F.count("session_id").alias("_n")).withColumn("_dm", F.trunc("_d", "MM")))
    asked = explode_months(sold.select(*pk, "_lo"), "period_start", "period_end", None, "_pm")
    met = asked.join(daily, (asked.organization_id == daily._org) & (asked._pm == daily._dm) & F.col("_d").between(F.col("period_start"), F.col("period_end")))
    counts = met.groupBy(*pk).agg(F.sum("_n").alias("ledger_sessions_count"),
                                  F.sum(F.when(F.col("_d") >= F.col("_lo"), F.col("_n"))).alias("naive_snapshot_sessions_count"))
    # Periods without any overlapping interval behave like one all-NULL slice (unlimited flag 1).
    f = sold.join(pe_matched, pk, "left").join(counts, pk, "left").withColumn("has_unlimited_slice", F.coalesce("has_unlimited_slice", F.lit(1)))
    ledger = F.coalesce("ledger_sessions_count", F.lit(0))
    unl = F.col("has_unlimited_slice") == 1
    corrected = F.when(unl, F.lit(0.0)).otherwise(
        F.greatest(ledger - F.coalesce("corrected_entitled_sessions", F.lit(0.0)), F.lit(0.0)))
    naive_n = F.coalesce("naive_snapshot_sessions_count", F.lit(0))
    naive = F.when(F.col("current_plan_sessions_limit").isNull(), F.lit(0)).otherwise(
        F.greatest(naive_n - F.col("current_plan_sessions_limit"), F.lit(0)))
    return f.select(
        "organization_id", "organization_name", "billing_email", "current_plan_id", "current_plan_name",
        F.col("period_start").alias("billing_period_start"), F.col("period_end").alias("billing_period_end"),
        ledger.alias("ledger_sessions_count"), "recorded_sessions_count", "recorded_session_minutes",
        "recorded_bytes_downloaded", "recorded_bytes_uploaded", "recorded_proxy_requests",
        F.round(F.when(unl, F.lit(None).cast("double")).otherwise(F.col("corrected_entitled_sessions")), 4)
         .alias("corrected_entitled_sessions"),
        F.round(corrected, 4).alias("corrected_overage_sessions"),
        "current_plan_sessions_limit", naive_n.alias("naive_snapshot_sessions_count"),
        naive.cast("long").alias("naive_overage_sessions"),
        F.round(corrected - naive, 4).alias("overage_leakage_delta"))


def fin_usage_billing_export(b) -> DataFrame:
    return usage_billing_export(b.usage_records, b.organizations, b.subscriptions, b.plans, b.sessions)


view("fin_billing", """
WITH held AS (  -- plan intervals by day, closed the day before the next one begins
  SELECT organization_id, subscription_id, CAST(since AS DATE) AS a, p.sessions_limit_monthly AS cap,
         list_min([CAST(till AS DATE), (SELECT CAST(min(CAST(n.since AS DATE)) - 1 AS DATE) FROM begun n WHERE n.organization_id = s.organization_id
           AND (CAST(n.since AS DATE), n.subscription_id) > (CAST(s.since AS DATE), s.subscription_id))]) AS z
  FROM begun s LEFT JOIN b_plans p USING (plan_id)),
by_org AS (SELECT organization_id, list({'a': a, 'z': z, 'cap': cap}) AS hs FROM held GROUP BY 1),
today AS (
  SELECT organization_id, arg_max({'sid': subscription_id, 'plan': plan_id}, ROW(ifnull(current_period_start, created_at), created_at, subscription_id)) AS cur
  FROM b_subscriptions GROUP BY 1),
sold AS (
  SELECT o.organization_id, o.organization_name, o.billing_email, cur.plan AS current_plan_id, p.plan_name AS current_plan_name,
         p.sessions_limit_monthly AS cap_now, (SELECT any_value(a) FROM held WHERE subscription_id = cur.sid) AS cur_from
  FROM b_organizations o LEFT JOIN today USING (organization_id) LEFT JOIN b_plans p ON p.plan_id = cur.plan),
usage AS (
  SELECT organization_id, period_start AS billing_period_start, period_end AS billing_period_end, max(sessions_count) AS recorded_sessions_count,
         max(session_minutes) AS recorded_session_minutes, max(bytes_downloaded) AS recorded_bytes_downloaded,
         max(bytes_uploaded) AS recorded_bytes_uploaded, max(proxy_requests) AS recorded_proxy_requests
  FROM b_usage_records GROUP BY 1, 2, 3),
run AS (SELECT organization_id, list(CAST(created_at AS DATE)) AS ds FROM b_sessions GROUP BY 1),
joined AS (
  SELECT u.*, s.* EXCLUDE (organization_id), len([d for d in ifnull(ds, []) if d BETWEEN billing_period_start AND billing_period_end]) AS ran,
         len([d for d in ifnull(ds, []) if d BETWEEN greatest(billing_period_start, cur_from) AND billing_period_end]) AS ran_now,
         date_diff('day', billing_period_start, billing_period_end) + 1 AS days,
         [h for h in ifnull(hs, []) if h.a <= billing_period_end AND h.z >= billing_period_start] AS over
  FROM usage u LEFT JOIN sold s USING (organization_id) LEFT JOIN run USING (organization_id) LEFT JOIN by_org USING (organization_id)),
owed AS (
  SELECT *, if(len(over) = 0 OR list_bool_or([h.cap IS NULL for h in over]), NULL, list_sum([
           h.cap * greatest(0, date_diff('day', greatest(h.a, billing_period_start), least(h.z, billing_period_end)) + 1)::DOUBLE / nullif(days, 0)
           for h in over])) AS entitled FROM joined),
due AS (SELECT *, if(entitled IS NULL, 0, greatest(ran - entitled, 0)) AS extra, if(cap_now IS NULL, 0, greatest(ran_now - cap_now, 0)) AS naive FROM owed)
SELECT organization_id, organization_name, billing_email, current_plan_id, current_plan_name, billing_period_start, billing_period_end,
       ran AS ledger_sessions_count, recorded_sessions_count, recorded_session_minutes, recorded_bytes_downloaded, recorded_bytes_uploaded,
       recorded_proxy_requests, round(entitled, 4) AS corrected_entitled_sessions, round(extra, 4) AS corrected_overage_sessions,
       cap_now AS current_plan_sessions_limit, ran_now AS naive_snapshot_sessions_count, CAST(naive AS BIGINT) AS naive_overage_sessions,
       round(extra - naive, 4) AS overage_leakage_delta
FROM due
""", "b_usage_records", "b_organizations", "b_subscriptions", "b_plans", "b_sessions", "begun")
register("fin_usage_billing_export", "SELECT * FROM fin_billing", ("fin_billing",),
         inputs=("stg_usage_records", "stg_organizations", "stg_subscriptions", "stg_plans",
                 "stg_sessions"))(fin_usage_billing_export)


# ------------------------------------------- plan x month matrix, customer drill
# Included session hours per customer by plan name (NULL = unlimited).
INCLUDED_HOURS = [("free", 1.0), ("developer", 100.0), ("starter", 100.0), ("startup", 500.0), ("pro", 500.0),
                  ("custom", None), ("enterprise", None)]


def _included_hours(plan_col):
    out = None
    for name, hours in INCLUDED_HOURS:
        cond = F.lower(plan_col) == name
        val = F.lit(hours).cast("double")
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(None).cast("double"))


def _plan_catalog(plans: DataFrame) -> DataFrame:
    return plans.select("plan_name", "monthly_price_usd", _included_hours(F.col("plan_name")).alias("included_hours"))


_INCLUDED_SQL = ("CASE WHEN lower({c}) = 'free' THEN 1.0 WHEN lower({c}) IN ('developer', 'starter') THEN 100.0 "
                 "WHEN lower({c}) IN ('startup', 'pro') THEN 500.0 ELSE NULL END")


def fin_plan_month_matrix(b) -> DataFrame:
    """Last 12 months x plan: customers, hours vs included capacity, expected
    (list-price) vs realised margin.  The grid is months observed x the plan
    catalogue (at most 12 x catalogue rows)."""
    cur = F.trunc(F.lit(b.as_of).cast("date"), "MM")
    cue = fin_customer_unit_economics(b).filter(F.col("metric_month").between(F.add_months(cur, -11), cur))
    m = cue.groupBy("metric_month", F.coalesce("primary_plan_name", F.lit("unknown")).alias("plan_name")).agg(
        F.countDistinct("organization_id").alias("customer_count"),
        exact_sum("total_session_hours", 6).alias("_h"), exact_sum("expected_cost_usd", 6).alias("_c"),
        exact_sum(F.coalesce("realized_revenue_usd", F.lit(0.0)), 2).alias("_r"))
    grid = m.select("metric_month").distinct().crossJoin(F.broadcast(_plan_catalog(b.plans)))  # bounded catalogue
    j = grid.join(m, ["metric_month", "plan_name"], "left")
    n = F.coalesce("customer_count", F.lit(0))
    h, c, r = (F.coalesce(x, F.lit(0.0)) for x in ("_h", "_c", "_r"))
    inc = F.col("included_hours")
    possible = n * F.coalesce(inc, F.lit(0.0))
    exp_rev = n * F.coalesce("monthly_price_usd", F.lit(0.0))
    unl = inc.isNull()
    return j.select(
        "metric_month", "plan_name", unl.alias("is_unlimited_plan"), n.alias("customer_count"),
        F.round(h, 2).alias("total_session_hours"),
        F.when(unl, F.lit(None).cast("double")).otherwise(F.round(possible, 2)).alias("possible_hours"),
        F.when(unl, F.lit(None).cast("double")).otherwise(F.round(h / F.nullif(possible, F.lit(0.0)) * 100, 2))
         .alias("utilization_pct"),
        F.round(c, 2).alias("expected_cost_usd"), F.round(exp_rev, 2).alias("expected_revenue_usd"),
        F.round(exp_rev - c, 2).alias("expected_margin_usd"),
        F.round((exp_rev - c) / F.nullif(exp_rev, F.lit(0.0)) * 100, 2).alias("expected_margin_pct"),
        F.round(r, 2).alias("realized_revenue_usd"), F.round(r - c, 2).alias("realized_margin_usd"),
        F.round((r - c) / F.nullif(r, F.lit(0.0)) * 100, 2).alias("realized_margin_pct"))


view("fin_plan_month_matrix", f"""
WITH pc AS (SELECT plan_name, monthly_price_usd, {_INCLUDED_SQL.format(c='plan_name')} AS inc FROM b_plans),
m AS (SELECT metric_month, coalesce(primary_plan_name, 'unknown') AS plan_name, count(DISTINCT organization_id) AS customer_count,
             sum(CAST(round(total_session_hours * 1000000) AS BIGINT)) / 1000000.0 AS h,
             sum(CAST(round(expected_cost_usd * 1000000) AS BIGINT)) / 1000000.0 AS c,
             sum(CAST(round(coalesce(realized_revenue_usd, 0) * 100) AS BIGINT)) / 100.0 AS r
      FROM fin_cue WHERE metric_month BETWEEN CAST(date_trunc('month', {AS_OF_SQL}) - INTERVAL 11 MONTH AS DATE)
                                          AND CAST(date_trunc('month', {AS_OF_SQL}) AS DATE)
      GROUP BY 1, 2),
g AS (SELECT mm.metric_month, pc.* FROM (SELECT DISTINCT metric_month FROM m) mm CROSS JOIN pc),
j AS (SELECT g.metric_month, g.plan_name, g.monthly_price_usd, g.inc, coalesce(m.customer_count, 0) AS n,
             coalesce(m.h, 0.0) AS h, coalesce(m.c, 0.0) AS c, coalesce(m.r, 0.0) AS r
      FROM g LEFT JOIN m ON g.metric_month = m.metric_month AND g.plan_name = m.plan_name)
SELECT metric_month, plan_name, inc IS NULL AS is_unlimited_plan, n AS customer_count, round(h, 2) AS total_session_hours,
       CASE WHEN inc IS NULL THEN NULL ELSE round(n * coalesce(inc, 0), 2) END AS possible_hours,
       CASE WHEN inc IS NULL THEN NULL ELSE round(h / nullif(n * coalesce(inc, 0), 0) * 100, 2) END AS utilization_pct,
       round(c, 2) AS expected_cost_usd, round(n * coalesce(monthly_price_usd, 0), 2) AS expected_revenue_usd,
       round(n * coalesce(monthly_price_usd, 0) - c, 2) AS expected_margin_usd,
       round((n * coalesce(monthly_price_usd, 0) - c) / nullif(n * coalesce(monthly_price_usd, 0), 0) * 100, 2) AS expected_margin_pct,
       round(r, 2) AS realized_revenue_usd, round(r - c, 2) AS realized_margin_usd,
       round((r - c) / nullif(r, 0) * 100, 2) AS realized_margin_pct
FROM j
""", "b_plans", "fin_cue")
register("fin_plan_month_matrix", "SELECT * FROM fin_plan_month_matrix", ("fin_plan_month_matrix",),
         inputs=("fin_customer_unit_economics", "stg_plans"))(fin_plan_month_matrix)


def fin_customer_drill(b) -> DataFrame:
    """Customers of the last complete month (all plans): hours vs the plan's
    included hours, expected (list price) vs realised margin."""
    month = F.add_months(F.trunc(F.lit(b.as_of).cast("date"), "MM"), -1)
    cue = fin_customer_unit_economics(b).filter(F.col("metric_month") == month)
    s = cue.groupBy("metric_month", "organization_id").agg(
        F.max("organization_name").alias("organization_name"),
        F.coalesce(F.max("primary_plan_name"), F.lit("unknown")).alias("plan_name"),
        exact_sum("total_session_hours", 6).alias("_h"), exact_sum("expected_cost_usd", 6).alias("_c"),
        exact_sum(F.coalesce("realized_revenue_usd", F.lit(0.0)), 2).alias("_r"))
    p = F.broadcast(_plan_catalog(b.plans).select(F.lower("plan_name").alias("_k"), "monthly_price_usd", "included_hours"))
    j = s.join(p, F.lower(s.plan_name) == F.col("_k"), "left")  # case-insensitive plan lookup
    h, c, r = (F.coalesce(x, F.lit(0.0)) for x in ("_h", "_c", "_r"))
    inc, price = F.col("included_hours"), F.coalesce("monthly_price_usd", F.lit(0.0))
    return j.select(
        "metric_month", "organization_id", "organization_name", "plan_name", F.round(h, 2).alias("total_session_hours"),
        F.when(inc.isNull(), F.lit(None).cast("double")).otherwise(F.round(inc, 2)).alias("possible_hours"),
        F.when(inc.isNull(), F.lit(None).cast("double")).otherwise(F.round(h / F.nullif(inc, F.lit(0.0)) * 100, 2))
         .alias("utilization_pct"),
        F.round(price, 2).alias("expected_revenue_usd"), F.round(c, 2).alias("expected_cost_usd"),
        F.round(price - c, 2).alias("expected_margin_usd"), F.round(r, 2).alias("realized_revenue_usd"),
        F.round(r - c, 2).alias("realized_margin_usd"))


view("fin_customer_drill", f"""
WITH s AS (SELECT metric_month, organization_id, max(organization_name) AS organization_name,
                  coalesce(max(primary_plan_name), 'unknown') AS plan_name,
                  sum(CAST(round(total_session_hours * 1000000) AS BIGINT)) / 1000000.0 AS h,
                  sum(CAST(round(expected_cost_usd * 1000000) AS BIGINT)) / 1000000.0 AS c,
                  sum(CAST(round(coalesce(realized_revenue_usd, 0) * 100) AS BIGINT)) / 100.0 AS r
           FROM fin_cue WHERE metric_month = CAST(date_trunc('month', {AS_OF_SQL}) - INTERVAL 1 MONTH AS DATE) GROUP BY 1, 2),
p AS (SELECT plan_name, monthly_price_usd, {_INCLUDED_SQL.format(c='plan_name')} AS inc FROM b_plans)
SELECT s.metric_month, s.organization_id, s.organization_name, s.plan_name, round(coalesce(s.h, 0), 2) AS total_session_hours,
       CASE WHEN p.inc IS NULL THEN NULL ELSE round(p.inc, 2) END AS possible_hours,
       CASE WHEN p.inc IS NULL THEN NULL ELSE round(coalesce(s.h, 0) / nullif(p.inc, 0) * 100, 2) END AS utilization_pct,
       round(coalesce(p.monthly_price_usd, 0), 2) AS expected_revenue_usd, round(coalesce(s.c, 0), 2) AS expected_cost_usd,
       round(coalesce(p.monthly_price_usd, 0) - coalesce(s.c, 0), 2) AS expected_margin_usd,
       round(coalesce(s.r, 0), 2) AS realized_revenue_usd, round(coalesce(s.r, 0) - coalesce(s.c, 0), 2) AS realized_margin_usd
FROM s LEFT JOIN p ON lower(s.plan_name) = lower(p.plan_name)
""", "fin_cue", "b_plans")
register("fin_customer_drill", "SELECT * FROM fin_customer_drill", ("fin_customer_drill",),
         inputs=("fin_customer_unit_economics", "stg_plans"))(fin_customer_drill)
