"""Staging layer: the normalised source entities and the projection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import AS_OF
from .oracle_views import AS_OF_TS_SQL
from .registry import register

# stg model -> (bindings attribute, oracle view).  The bindings already are the
# cleaned, typed, renamed staging entities of the driver's tables.
STAGING = {
    "stg_organizations": ("organizations", "b_organizations"),
    "stg_users": ("users", "b_users"),
    "stg_sessions": ("sessions", "b_sessions"),
    "stg_session_events": ("session_events", "b_session_events"),
    "stg_usage_records": ("usage_records", "b_usage_records"),
    "stg_invoices": ("invoices", "b_invoices"),
    "stg_gtm_employees": ("employees", "b_employees"),
    "stg_gtm_accounts": ("accounts", "b_accounts"),
    "stg_gtm_contacts": ("contacts", "b_contacts"),
    "stg_gtm_leads": ("leads", "b_leads"),
    "stg_gtm_campaigns": ("campaigns", "b_campaigns"),
    "stg_gtm_lead_touches": ("lead_touches", "b_lead_touches"),
    "stg_gtm_opportunities": ("opportunities", "b_opportunities"),
    "stg_gtm_activities": ("activities", "b_activities"),
    "stg_finance_departments": ("fin_departments", "b_fin_departments"),
    "stg_finance_vendors": ("fin_vendors", "b_fin_vendors"),
    "stg_finance_cards": ("fin_cards", "b_fin_cards"),
    "stg_finance_transactions": ("fin_transactions", "b_fin_transactions"),
    "stg_finance_reimbursements": ("fin_reimbursements", "b_fin_reimbursements"),
    "stg_finance_bills": ("fin_bills", "b_fin_bills"),
    "stg_finance_bill_payments": ("fin_bill_payments", "b_fin_bill_payments"),
    "stg_finance_bill_adjustments": ("fin_bill_adjustments", "b_fin_bill_adjustments"),
    "stg_finance_payment_reversals": ("fin_payment_reversals", "b_fin_payment_reversals"),
}


def _staging(attr):
    def build(b):
        return getattr(b, attr)

    build.__name__ = attr
    return build


for _name, (_attr, _view) in STAGING.items():
    register(_name, f"SELECT * FROM {_view}", (_view,))(_staging(_attr))


def stg_subscriptions(b):
    s = b.subscriptions
    return s.withColumn("is_in_trial", F.coalesce(F.col("trial_ends_at") > F.lit(f"{b.as_of} 00:00:00")
                                                   .cast("timestamp_ntz"), F.lit(False)))


register("stg_subscriptions", f"SELECT *, coalesce(trial_ends_at > {AS_OF_TS_SQL}, FALSE) AS is_in_trial FROM b_subscriptions",
         ("b_subscriptions",))(stg_subscriptions)


# ----------------------------------------------------- projection operators
@register("prj_cast_rename", """SELECT CAST(o_orderkey AS VARCHAR) AS order_ref, CAST(o_custkey AS INTEGER) AS customer_id,
       CAST(o_orderdate AS DATE) AS order_date, CAST(o_totalprice AS DOUBLE) AS total_price FROM orders""")
def prj_cast_rename(b):
    o = b.t.orders
    return o.select(F.col("o_orderkey").cast("string").alias("order_ref"), F.col("o_custkey").cast("int").alias("customer_id"),
                    F.col("o_orderdate").cast("date").alias("order_date"),
                    F.col("o_totalprice").cast("double").alias("total_price"))


@register("prj_enum_lower", "SELECT c_custkey, lower(trim(c_mktsegment)) AS segment FROM customer")
def prj_enum_lower(b):
    return b.t.customer.select("c_custkey", F.lower(F.trim("c_mktsegment")).alias("segment"))


@register("prj_code_upper", "SELECT n_nationkey, upper(trim(substr(n_name, 1, 3))) AS country_code FROM nation")
def prj_code_upper(b):
    return b.t.nation.select("n_nationkey", F.upper(F.trim(F.substring("n_name", 1, 3))).alias("country_code"))


@register("prj_money", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS total_usd FROM orders")
def prj_money(b):
    return b.t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("total_usd"))


@register("prj_duration_seconds", """SELECT session_id, CASE WHEN ended_at IS NOT NULL AND started_at IS NOT NULL
       THEN CAST(date_diff('second', started_at, ended_at) AS INTEGER) END AS duration_seconds FROM b_sessions""",
          ("b_sessions",))
def prj_duration_seconds(b):
    s = b.sessions
    both = F.col("ended_at").isNotNull() & F.col("started_at").isNotNull()
    return s.select("session_id", F.when(both, F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at"))
                                         .cast("int")).alias("duration_seconds"))


@register("prj_flag_future", f"""SELECT subscription_id, coalesce(trial_ends_at > {AS_OF_TS_SQL}, FALSE) AS is_in_trial
FROM b_subscriptions""", ("b_subscriptions",))
def prj_flag_future(b):
    return b.subscriptions.select("subscription_id", F.coalesce(
        F.col("trial_ends_at") > F.lit(f"{b.as_of} 00:00:00").cast("timestamp_ntz"), F.lit(False)).alias("is_in_trial"))


@register("prj_passthrough_json", "SELECT event_id, props AS event_data FROM events")
def prj_passthrough_json(b):
    return b.t.events.select("event_id", F.col("props").alias("event_data"))
