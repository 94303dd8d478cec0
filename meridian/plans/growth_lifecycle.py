"""Account lifecycle staging and GTM unit economics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, exact_sum
from ..operators.shapes import dated_measures, referenced
from .core import dim_organizations
from .finance import revenue_amounts
from .growth import campaign_months
from .registry import register


def _days_between(later, earlier):
    return F.round(F.timestamp_diff("SECOND", F.col(earlier), F.col(later)) / 86400.0, 2)


def account_milestones(accounts, leads, opps, activities, orgs, sessions, revenue) -> DataFrame:
    """Accounts with what their leads, deals, activities, usage and payments say.
    Every branch is aggregated to account/org grain before the star join, so the
    join never fans out."""
    st = F.col("lead_status")
    ls = leads.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("leads_total"), count_if(st == "qualified").alias("leads_qualified"),
        count_if(st == "converted").alias("leads_converted"), F.min("created_at").alias("first_prospect_at"),
        F.min(F.when(st.isin("qualified", "converted"), F.col("updated_at"))).alias("first_qualified_at"),
        F.min("converted_at").alias("first_lead_converted_at"), F.max("created_at").alias("last_lead_at"),
        F.min("owner_employee_id").alias("first_lead_owner_employee_id"))
    stage = F.col("stage")
    os_ = opps.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("opportunities_total"),
        count_if(~stage.isin("closed_won", "closed_lost")).alias("open_opportunities"),
        count_if(stage == "closed_won").alias("won_opportunities"),
        count_if(stage == "closed_lost").alias("lost_opportunities"),
        exact_sum(F.when(stage == "closed_won", F.coalesce("amount_usd", F.lit(0.0))).otherwise(0.0), 2)
        .alias("won_revenue_usd"),
        F.min("created_at").alias("first_opportunity_at"),
        F.min(F.when(stage == "closed_won", F.col("closed_at"))).alias("first_closed_won_at"),
        F.max("closed_at").alias("last_closed_at"),
        F.min("owner_employee_id").alias("first_opportunity_owner_employee_id"))
    at = F.col("activity_type")
    ac = activities.filter(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("activities_total"), count_if(at == "email").alias("emails_total"),
        count_if(at == "call").alias("calls_total"), count_if(at == "meeting").alias("meetings_total"),
        F.min("occurred_at").alias("first_activity_at"), F.max("occurred_at").alias("last_activity_at"))
    bs = revenue.groupBy("organization_id").agg(
        F.min(F.when(F.col("realized_revenue_usd") > 0, F.col("revenue_month"))).alias("first_paid_month"),
        exact_sum(F.coalesce("realized_revenue_usd", F.lit(0.0)), 2).alias("lifetime_realized_revenue_usd"))
    us = sessions.groupBy("organization_id").agg(
        F.min("started_at").alias("first_product_usage_at"), F.max("started_at").alias("last_product_usage_at"),
        F.count(F.lit(1)).alias("lifetime_sessions"))
    o = orgs.select("organization_id", "organization_status", "is_paying_customer")

    j = (accounts.join(o, "organization_id", "left").join(ls, "account_id", "left").join(os_, "account_id", "left")
         .join(ac, "account_id", "left").join(bs, "organization_id", "left").join(us, "organization_id", "left"))
    using = F.col("first_product_usage_at").isNotNull()
    staying = using & (F.col("last_product_usage_at") >= F.col("first_product_usage_at") + F.expr("INTERVAL 30 DAYS"))
    paid = F.col("first_paid_month").isNotNull() | F.coalesce(F.col("is_paying_customer"), F.lit(False))
    return j.withColumns({"first_paid_at": F.col("first_paid_month").cast("timestamp_ntz"), "is_using": using, "is_staying_30d": staying, "did_pay": paid})


def lifecycle_accounts(milestones, employees, leads, opps, accounts) -> DataFrame:
    """Per account: owners, funnel milestones, stage-to-stage durations and the
    lifecycle stage."""
    owners = referenced(employees.select("employee_id", "full_name", "employee_email"), "employee_id",
                        (accounts, "owner_employee_id"), (leads, "owner_employee_id"), (opps, "owner_employee_id"))

    def owner(prefix):
        return owners.select(F.col("employee_id").alias(f"{prefix}_id"), F.col("full_name").alias(f"{prefix}_name"),
                             F.col("employee_email").alias(f"{prefix}_email"))

    j = (milestones.join(owner("ao"), F.col("owner_employee_id") == F.col("ao_id"), "left")
         .join(owner("lo"), F.col("first_lead_owner_employee_id") == F.col("lo_id"), "left")
         .join(owner("oo"), F.col("first_opportunity_owner_employee_id") == F.col("oo_id"), "left"))
    using, staying, paid = F.col("is_using"), F.col("is_staying_30d"), F.col("did_pay")
    stage_ladder = (F.when(F.col("organization_status") == "churned", "churned").when(staying, "retained_customer")
                    .when(using, "active_customer").when(paid, "paid_customer")
                    .when(F.col("first_closed_won_at").isNotNull(), "closed_won")
                    .when(F.col("first_opportunity_at").isNotNull(), "opportunity")
                    .when(F.col("first_qualified_at").isNotNull(), "qualified")
                    .when(F.col("first_prospect_at").isNotNull(), "prospect").otherwise("target"))
    z = lambda c, v=0: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return j.select(
        "account_id", "organization_id", "account_name", "account_status", "account_tier", "industry", "employee_band",
        "source_system", F.col("owner_employee_id").alias("account_owner_employee_id"),
        F.col("ao_name").alias("account_owner_name"), F.col("ao_email").alias("account_owner_email"),
        "first_lead_owner_employee_id", F.col("lo_name").alias("first_lead_owner_name"),
        "first_opportunity_owner_employee_id", F.col("oo_name").alias("first_opportunity_owner_name"),
        z("leads_total"), z("leads_qualified"), z("leads_converted"), z("opportunities_total"), z("open_opportunities"),
        z("won_opportunities"), z("lost_opportunities"), z("won_revenue_usd", 0.0), z("activities_total"),
        z("emails_total"), z("calls_total"), z("meetings_total"),
        "first_prospect_at", "first_qualified_at", "first_opportunity_at", "first_closed_won_at", "first_paid_at",
        "first_product_usage_at", "last_product_usage_at", "last_activity_at",
        _days_between("first_qualified_at", "first_prospect_at").alias("days_prospect_to_qualified"),
        _days_between("first_opportunity_at", "first_qualified_at").alias("days_qualified_to_opportunity"),
        _days_between("first_closed_won_at", "first_opportunity_at").alias("days_opportunity_to_closed_won"),
        _days_between("first_paid_at", "first_closed_won_at").alias("days_closed_won_to_paid"),
        z("lifetime_realized_revenue_usd", 0.0), z("lifetime_sessions"),
        "did_pay", "is_using", "is_staying_30d",
        stage_ladder.alias("lifecycle_stage"), F.col("created_at").alias("account_created_at"),
        F.col("updated_at").alias("account_updated_at"))


def gtm_lifecycle_accounts(b) -> DataFrame:
    return lifecycle_accounts(milestones(b), b.employees, b.leads, b.opportunities, b.accounts)


def milestones(b) -> DataFrame:
    return account_milestones(b.accounts, b.leads, b.opportunities, b.activities, dim_organizations(b), b.sessions, revenue_amounts(b))


_LIFECYCLE_SQL = """
WITH touches AS (  -- everything that happened to an account
  SELECT account_id, 'lead' AS kind, lead_status AS state, created_at AS happened_at, updated_at AS changed, owner_employee_id AS owner, 0::BIGINT AS cents
  FROM b_leads
  UNION ALL SELECT account_id, 'deal', stage, created_at, closed_at, owner_employee_id, CAST(round(ifnull(amount_usd, 0) * 100) AS BIGINT)
  FROM b_opportunities
  UNION ALL SELECT account_id, 'act', activity_type, occurred_at, NULL, NULL, 0 FROM b_activities),
by_account AS (
  SELECT account_id, count(*) FILTER (kind = 'lead') AS leads_total, count(*) FILTER (kind = 'lead' AND state = 'qualified') AS leads_qualified,
         count(*) FILTER (kind = 'lead' AND state = 'converted') AS leads_converted, count(*) FILTER (kind = 'deal') AS opportunities_total,
         count(*) FILTER (kind = 'deal' AND NOT starts_with(state, 'closed_')) AS open_opportunities,
         count(*) FILTER (kind = 'deal' AND state = 'closed_won') AS won_opportunities,
         count(*) FILTER (kind = 'deal' AND state = 'closed_lost') AS lost_opportunities,
         coalesce(sum(cents) FILTER (state = 'closed_won'), 0) / 100.0 AS won_revenue_usd,
         count(*) FILTER (kind = 'act') AS activities_total, count(*) FILTER (kind = 'act' AND state = 'email') AS emails_total,
         count(*) FILTER (kind = 'act' AND state = 'call') AS calls_total, count(*) FILTER (kind = 'act' AND state = 'meeting') AS meetings_total,
         min(happened_at) FILTER (kind = 'lead') AS first_prospect_at,
         min(changed) FILTER (kind = 'lead' AND state IN ('qualified', 'converted')) AS first_qualified_at,
         min(happened_at) FILTER (kind = 'deal') AS first_opportunity_at, min(changed) FILTER (kind = 'deal' AND state = 'closed_won') AS first_closed_won_at,
         max(happened_at) FILTER (kind = 'act') AS last_activity_at, min(owner) FILTER (kind = 'lead') AS lead_owner, min(owner) FILTER (kind = 'deal') AS deal_owner
  FROM touches GROUP BY account_id),
by_org AS (
  SELECT organization_id, min(happened_at) FILTER (NOT paid) AS first_product_usage_at, max(happened_at) FILTER (NOT paid) AS last_product_usage_at,
         count(*) FILTER (NOT paid) AS lifetime_sessions, min(happened_at) FILTER (paid AND usd > 0) AS first_paid_at,
         coalesce(sum(CAST(round(usd * 100) AS BIGINT)) FILTER (paid), 0) / 100.0 AS lifetime_realized_revenue_usd
  FROM (SELECT organization_id, started_at AS happened_at, FALSE AS paid, NULL::DOUBLE AS usd FROM b_sessions
        UNION ALL SELECT organization_id, CAST(revenue_month AS TIMESTAMP), TRUE, realized_revenue_usd FROM fin_monthly_revenue) GROUP BY 1),
whole AS (
  SELECT a.*, t.* EXCLUDE (account_id), u.* EXCLUDE (organization_id),
         ifnull((SELECT any_value(is_paying_customer) FROM dim_organizations d WHERE d.organization_id = a.organization_id), FALSE)
           OR u.first_paid_at IS NOT NULL AS did_pay,
         (SELECT any_value(organization_status) FROM dim_organizations d WHERE d.organization_id = a.organization_id) AS standing,
         u.first_product_usage_at IS NOT NULL AS is_using,
         ifnull(u.last_product_usage_at - INTERVAL 30 DAY >= u.first_product_usage_at, FALSE) AS is_staying_30d
  FROM b_accounts a LEFT JOIN by_account t ON t.account_id = a.account_id LEFT JOIN by_org u ON u.organization_id = a.organization_id)
SELECT account_id, organization_id, account_name, account_status, account_tier, industry, employee_band, source_system,
       owner_employee_id AS account_owner_employee_id, own.name AS account_owner_name, own.mail AS account_owner_email,
       lead_owner AS first_lead_owner_employee_id, lead_name.name AS first_lead_owner_name,
       deal_owner AS first_opportunity_owner_employee_id, deal_name.name AS first_opportunity_owner_name,
       COLUMNS(['first_prospect_at', 'first_qualified_at', 'first_opportunity_at', 'first_closed_won_at', 'first_paid_at',
                          'first_product_usage_at', 'last_product_usage_at', 'last_activity_at', 'did_pay', 'is_using', 'is_staying_30d']),
       ifnull(COLUMNS(['leads_total', 'leads_qualified', 'leads_converted', 'opportunities_total', 'open_opportunities',
                                 'won_opportunities', 'lost_opportunities', 'won_revenue_usd', 'activities_total', 'emails_total',
                                 'calls_total', 'meetings_total', 'lifetime_realized_revenue_usd', 'lifetime_sessions']), 0),
       round(date_diff('second', first_prospect_at, first_qualified_at) / 86400.0, 2) AS days_prospect_to_qualified,
       round(date_diff('second', first_qualified_at, first_opportunity_at) / 86400.0, 2) AS days_qualified_to_opportunity,
       round(date_diff('second', first_opportunity_at, first_closed_won_at) / 86400.0, 2) AS days_opportunity_to_closed_won,
       round(date_diff('second', first_closed_won_at, first_paid_at) / 86400.0, 2) AS days_closed_won_to_paid,
       ['churned', 'retained_customer', 'active_customer', 'paid_customer', 'closed_won', 'opportunity', 'qualified', 'prospect', 'target'][
         list_position([ifnull(standing = 'churned', FALSE), is_staying_30d, is_using, did_pay, first_closed_won_at IS NOT NULL,
                        first_opportunity_at IS NOT NULL, first_qualified_at IS NOT NULL, first_prospect_at IS NOT NULL, TRUE], TRUE)]
         AS lifecycle_stage,
       created_at AS account_created_at, updated_at AS account_updated_at
FROM whole
LEFT JOIN (SELECT employee_id, full_name AS name, employee_email AS mail FROM b_employees) own ON own.employee_id = owner_employee_id
LEFT JOIN (SELECT employee_id, full_name AS name FROM b_employees) lead_name ON lead_name.employee_id = lead_owner
LEFT JOIN (SELECT employee_id, full_name AS name FROM b_employees) deal_name ON deal_name.employee_id = deal_owner
"""
from .oracle_views import view  # noqa: E402

view("gtm_lifecycle_accounts", _LIFECYCLE_SQL, "b_leads", "b_opportunities", "b_activities", "fin_monthly_revenue",
     "b_sessions", "b_accounts", "dim_organizations", "b_employees")
register("gtm_lifecycle_accounts", "SELECT * FROM gtm_lifecycle_accounts", ("gtm_lifecycle_accounts",),
         inputs=("stg_gtm_accounts", "stg_gtm_employees", "stg_gtm_leads", "stg_gtm_opportunities",
                 "stg_gtm_activities", "dim_organizations", "stg_sessions", "fin_monthly_revenue"))(gtm_lifecycle_accounts)


# ------------------------------------------------------ GTM unit economics
def gtm_unit_economics(b) -> DataFrame:
    """Months of account milestones, campaigns and revenue, stacked as (month,
    amounts) and summed once; the accounts are planned and read a single time."""
    one, cents = F.lit(1), lambda c: F.round(F.col(c).cast("double") * 100)
    counts = ("leads_created", "leads_qualified", "leads_converted", "opportunities_total", "opportunities_won")
    told = [
        dated_measures(milestones(b), [
            ("created_at", {"new_accounts": one}), ("first_prospect_at", {"new_prospects": one}), ("first_paid_at", {"new_paid_customers": one}),
            ("first_product_usage_at", {"new_using_customers": one, "retained_30d_customers": F.col("is_staying_30d").cast("int")})], "MM", "metric_month"),
        dated_measures(campaign_months(b), [("metric_month", {**{c: F.col(c) for c in counts}, "_spend": cents("campaign_budget_usd"), "_won": cents("won_revenue_usd")})], "MM", "metric_month"),
        dated_measures(revenue_amounts(b), [("revenue_month", {"_realized": cents("realized_revenue_usd"),
                                                               "paying_customers_in_month": (F.col("realized_revenue_usd") > 0).cast("int")})], "MM", "metric_month"),
    ]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), told)
    out = rows.groupBy("metric_month").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "metric_month"]).withColumns({
        "campaign_spend_usd": F.col("_spend") / 100.0, "pipeline_won_revenue_usd": F.col("_won") / 100.0, "realized_revenue_usd": F.col("_realized") / 100.0})
    z = lambda c, v=0: F.coalesce(F.col(c), F.lit(v))
    paid, ret = z("new_paid_customers").cast("double"), z("retained_30d_customers").cast("double")
    rate = ret / F.nullif(paid, F.lit(0.0))
    arpu = z("realized_revenue_usd", 0.0) / F.nullif(z("paying_customers_in_month").cast("double"), F.lit(0.0))
    cols = ["new_accounts", "new_prospects", "new_paid_customers", "new_using_customers", "retained_30d_customers",
            "leads_created", "leads_qualified", "leads_converted", "opportunities_total", "opportunities_won"]
    return out.select(
        "metric_month", *[z(c).alias(c) for c in cols],
        z("campaign_spend_usd", 0.0).alias("campaign_spend_usd"),
        z("pipeline_won_revenue_usd", 0.0).alias("pipeline_won_revenue_usd"),
        z("realized_revenue_usd", 0.0).alias("realized_revenue_usd"),
        z("paying_customers_in_month").alias("paying_customers_in_month"),
        F.round(z("campaign_spend_usd", 0.0) / F.nullif(paid, F.lit(0.0)), 2).alias("cac_usd"),
        F.round(arpu, 2).alias("arpu_usd"), F.round(rate, 4).alias("retention_30d_rate"),
        F.round(z("pipeline_won_revenue_usd", 0.0) / F.nullif(z("campaign_spend_usd", 0.0), F.lit(0.0)), 4)
         .alias("pipeline_roas"),
        F.round(arpu * (rate / F.nullif(F.lit(1.0) - rate, F.lit(0.0))), 2).alias("ltv_proxy_usd"))


view("gtm_unit_economics", """
WITH told AS (  -- (month, measure, amount); campaign and revenue money in cents
  SELECT account_created_at AS happened_at, 'new_accounts' AS m, 1::BIGINT AS n FROM gtm_lifecycle_accounts
  UNION ALL SELECT first_prospect_at, 'new_prospects', 1 FROM gtm_lifecycle_accounts
  UNION ALL SELECT first_paid_at, 'new_paid_customers', 1 FROM gtm_lifecycle_accounts
  UNION ALL SELECT first_product_usage_at, unnest(['new_using_customers', if(is_staying_30d, 'retained_30d_customers', NULL)]), 1
  FROM gtm_lifecycle_accounts
  UNION ALL SELECT metric_month, unnest(['leads_created', 'leads_qualified', 'leads_converted', 'opportunities_total',
                                         'opportunities_won', 'spend', 'won']),
                   unnest([leads_created, leads_qualified, leads_converted, opportunities_total, opportunities_won,
                           CAST(round(campaign_budget_usd * 100) AS BIGINT), CAST(round(won_revenue_usd * 100) AS BIGINT)])
  FROM gtm_campaign_channel
  UNION ALL SELECT revenue_month, 'realized', sum(CAST(round(realized_revenue_usd * 100) AS BIGINT)) FROM fin_monthly_revenue GROUP BY 1
  UNION ALL SELECT revenue_month, 'paying', count(DISTINCT organization_id) FILTER (realized_revenue_usd > 0) FROM fin_monthly_revenue GROUP BY 1),
book AS (
  SELECT CAST(date_trunc('month', happened_at) AS DATE) AS metric_month, map_from_entries(list((m, n))) AS b
  FROM (SELECT date_trunc('month', happened_at) AS happened_at, m, CAST(sum(n) AS BIGINT) AS n FROM told WHERE happened_at IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2)
  GROUP BY 1),
flat AS (
  SELECT metric_month, ifnull(b['new_accounts'], 0) AS new_accounts, ifnull(b['new_prospects'], 0) AS new_prospects,
         ifnull(b['new_paid_customers'], 0) AS new_paid_customers, ifnull(b['new_using_customers'], 0) AS new_using_customers,
         ifnull(b['retained_30d_customers'], 0) AS retained_30d_customers, ifnull(b['leads_created'], 0) AS leads_created,
         ifnull(b['leads_qualified'], 0) AS leads_qualified, ifnull(b['leads_converted'], 0) AS leads_converted,
         ifnull(b['opportunities_total'], 0) AS opportunities_total, ifnull(b['opportunities_won'], 0) AS opportunities_won,
         ifnull(b['spend'], 0) / 100.0 AS campaign_spend_usd, ifnull(b['won'], 0) / 100.0 AS pipeline_won_revenue_usd,
         ifnull(b['realized'], 0) / 100.0 AS realized_revenue_usd, ifnull(b['paying'], 0) AS paying_customers_in_month FROM book),
rated AS (SELECT *, retained_30d_customers / nullif(new_paid_customers::DOUBLE, 0) AS kept,
                 realized_revenue_usd / nullif(paying_customers_in_month::DOUBLE, 0) AS each_pays FROM flat)
SELECT * EXCLUDE (kept, each_pays), round(campaign_spend_usd / nullif(new_paid_customers::DOUBLE, 0), 2) AS cac_usd,
       round(each_pays, 2) AS arpu_usd, round(kept, 4) AS retention_30d_rate,
       round(pipeline_won_revenue_usd / nullif(campaign_spend_usd, 0), 4) AS pipeline_roas,
       round(each_pays * (kept / nullif(1.0 - kept, 0)), 2) AS ltv_proxy_usd
FROM rated
""", "gtm_lifecycle_accounts", "gtm_campaign_channel", "fin_monthly_revenue")
register("gtm_unit_economics", "SELECT * FROM gtm_unit_economics", ("gtm_unit_economics",),
         inputs=("gtm_lifecycle_accounts", "gtm_campaign_channel", "fin_monthly_revenue"))(gtm_unit_economics)
