"""Canonical business entities bound to the driver's TPC-like tables.

The engine's data products are written against a SaaS data model
(organizations, subscriptions, browser sessions, invoices, leads, ...).  The
test tables are TPC-H-like, so every canonical entity is a deterministic,
row-wise projection (or a small aggregation) of one raw table.  Every binding is
a narrow transformation: no shuffle except where an entity is itself an
aggregate (users, usage records).  The DuckDB twin of every binding lives in
``meridian.plans.oracle_views`` and the two are kept in lock-step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import add_days_ts, add_seconds_ts
from ..session import AS_OF
from .tables import Tables

# Plan catalogue (id, display name, monthly price USD, sessions
# per month (NULL = unlimited), concurrent sessions, max session minutes,
# stealth, residential proxies, priority support).
PLAN_ROWS = [
    ("free", "Free", 0.0, 100, 2, 5, False, False, False),
    ("starter", "Starter", 49.0, 1000, 5, 30, True, False, False),
    ("pro", "Pro", 199.0, 10000, 20, 60, True, True, False),
    ("enterprise", "Enterprise", 999.0, None, 100, 120, True, True, True),
]
# Expected infrastructure cost per session hour (USD) by plan,
# first effective range; the second range (from PLAN_COST_SWITCH) is +20%.
PLAN_COST_PER_HOUR = [("free", 0.60), ("starter", 0.95), ("pro", 1.45), ("enterprise", 2.10)]
PLAN_COST_START = "1990-01-01 00:00:00"
PLAN_COST_SWITCH = "1998-07-01 00:00:00"

PLAN_SCHEMA = T.StructType([
    T.StructField("plan_id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("monthly_price_usd", T.DoubleType()),
    T.StructField("sessions_limit_monthly", T.IntegerType()),
    T.StructField("concurrent_sessions_limit", T.IntegerType()),
    T.StructField("max_session_duration_mins", T.IntegerType()),
    T.StructField("has_stealth_mode", T.BooleanType()),
    T.StructField("has_residential_proxies", T.BooleanType()),
    T.StructField("has_priority_support", T.BooleanType()),
])

OPEN_END = "2999-12-31 00:00:00"


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _case(col, mapping: dict, default=None):
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out.otherwise(F.lit(default)) if default is not None else out


ORDER_STATUS_TO_SESSION = {"F": "completed", "O": "failed", "P": "timeout"}
PRIORITY_TO_BROWSER = {"1": "chromium", "2": "firefox", "3": "webkit", "4": "chromium"}
PRIORITY_TO_PLAN = {"1-URGENT": "enterprise", "2-HIGH": "pro", "3-MEDIUM": "starter",
                    "4-NOT SPECIFIED": "starter"}
SEGMENT_TO_PLAN = {"AUTOMOBILE": "free", "BUILDING": "starter", "FURNITURE": "pro",
                   "HOUSEHOLD": "enterprise"}
RETURNFLAG_TO_EVENT = {"A": "navigation", "N": "click", "R": "error"}
INVOICE_STATUS = {"F": "paid", "O": "open", "P": "void"}


class Bindings:
    """All canonical entities of one data directory (lazy DataFrames)."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self.as_of = as_of
        #: Products already written as tables, by name; products built on them read these.
        self.stored: dict[str, DataFrame] = {}

    # ------------------------------------------------------------------ plans
    @cached_property
    def plans(self) -> DataFrame:
        return (self.spark.createDataFrame(PLAN_ROWS, PLAN_SCHEMA)
                .withColumn("plan_name", F.col("plan_id")))

    @cached_property
    def plan_economics(self) -> DataFrame:
        rows = []
        for pid, cost in PLAN_COST_PER_HOUR:
            rows.append((f"pe_{pid}_1", pid, cost, PLAN_COST_START, PLAN_COST_SWITCH))
            rows.append((f"pe_{pid}_2", pid, round(cost * 1.2, 4), PLAN_COST_SWITCH, None))
        df = self.spark.createDataFrame(
            rows, "plan_economics_id string, plan_id string, expected_cost_per_hour_usd double, "
                  "effective_start string, effective_end string")
        return (df.withColumn("effective_start", F.col("effective_start").cast("timestamp_ntz"))
                  .withColumn("effective_end", F.col("effective_end").cast("timestamp_ntz")))

    # ---------------------------------------------------------- organizations
    @property
    def organizations(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        status = (F.when(k % 20 == 0, F.lit("churned"))
                  .when(k % 20 == 1, F.lit("suspended")).otherwise(F.lit("active")))
        created = F.date_add(F.lit("1995-01-01").cast("date"), ((k * 37) % 2000).cast("int")).cast("timestamp_ntz")
        return c.select(
            k.alias("organization_id"),
            F.col("c_name").alias("organization_name"),
            F.lower(F.regexp_replace("c_name", "#", "-")).alias("organization_slug"),
            status.alias("status"),
            F.concat(F.lit("cus_"), k.cast("string")).alias("stripe_customer_id"),
            F.concat(F.lit("billing+"), k.cast("string"), F.lit("@example.com")).alias("billing_email"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation_id"),
            created.alias("created_at"),
        )

    # ---------------------------------------------------------------- users
    @property
    def users(self) -> DataFrame:
        """One user per distinct ``events.user_id``; first/last event times."""
        e = self.t.events
        return (e.groupBy(F.col("user_id"))
                 .agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_login_at"))
                 .select("user_id",
                         F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
                         F.when(F.col("user_id") % 3 == 0, F.lit("google")).otherwise(F.lit("email")).alias("auth_provider"),
                         (F.col("user_id") % 5 != 0).alias("is_email_verified"),
                         "last_login_at", "created_at"))

    @property
    def organization_members(self) -> DataFrame:
        """Every user belongs to org ``user_id % 50``; even users also to the next org."""
        u = self.users.select("user_id", "created_at")
        first = u.select("user_id", (F.col("user_id") % 50).alias("organization_id"),
                         F.lit("owner").alias("role"), F.col("created_at").alias("joined_at"))
        second = (u.filter(F.col("user_id") % 2 == 0)
                   .select("user_id", ((F.col("user_id") + 1) % 50).alias("organization_id"),
                           F.lit("member").alias("role"),
                           add_days_ts("created_at", 1).alias("joined_at")))
        return first.unionByName(second)

    # ------------------------------------------------------------- sessions
    @property
    def sessions(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        dur = F.when(k % 17 == 0, F.lit(None).cast("int")).otherwise((F.lit(30) + (k * 7919) % 2700).cast("int"))
        started = F.col("o_orderdate")
        return o.select(
            k.alias("session_id"),
            F.col("o_custkey").alias("organization_id"),
            (k % 5).alias("project_id"),
            F.col("o_custkey").alias("api_key_id"),
            _case(F.substring("o_orderpriority", 1, 1), PRIORITY_TO_BROWSER, "firefox").alias("browser_type"),
            (F.lit(1280) + (k % 3) * 320).cast("int").alias("viewport_width"),
            (F.lit(720) + (k % 2) * 180).cast("int").alias("viewport_height"),
            F.when(k % 4 == 0, F.lit("residential")).alias("proxy_type"),
            F.when(k % 4 == 0, F.lit("US")).alias("proxy_country"),
            (k % 3 == 0).alias("is_stealth_mode"),
            _case(F.col("o_orderstatus"), ORDER_STATUS_TO_SESSION).alias("status"),
            started.alias("started_at"),
            add_seconds_ts(started, dur).alias("ended_at"),
            add_seconds_ts(started, 3600).alias("timeout_at"),
            dur.alias("duration_seconds"),
            F.concat(F.lit("https://app"), (F.col("o_custkey") % 97).cast("string"),
                     F.lit(".example.com/p/"), (k % 13).cast("string")).alias("initial_url"),
            (F.lit(1) + k % 20).cast("int").alias("pages_visited"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes_downloaded"),
            ((k * 131) % 100000).alias("bytes_uploaded"),
            started.alias("created_at"),
        )

    @property
    def session_events(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
            F.col("l_orderkey").alias("session_id"),
            _case(F.col("l_returnflag"), RETURNFLAG_TO_EVENT).alias("event_type"),
            F.concat(F.lit('{"line": '), F.col("l_linenumber").cast("string"), F.lit("}")).alias("event_data"),
            F.col("l_shipdate").alias("event_at"),
        )

    # -------------------------------------------------------- subscriptions
    @property
    def subscriptions(self) -> DataFrame:
        as_of = _ts(f"{self.as_of} 00:00:00")
        o = self.t.orders.filter(F.col("o_orderstatus") == "F")
        k = F.col("o_orderkey")
        end = F.when(k % 7 == 0, _ts(OPEN_END)).otherwise(add_days_ts("o_orderdate", 180))
        paid = (o.select(
            k.alias("subscription_id"),
            F.col("o_custkey").alias("organization_id"),
            _case(F.col("o_orderpriority"), PRIORITY_TO_PLAN, "free").alias("plan_id"),
            F.col("o_orderdate").alias("current_period_start"),
            end.alias("current_period_end"),
            F.lit(None).cast("timestamp_ntz").alias("trial_ends_at"),
            F.col("o_orderdate").alias("created_at"))
            .withColumn("status", F.when(F.col("current_period_end") >= as_of, F.lit("active"))
                        .otherwise(F.lit("canceled")))
            .withColumn("canceled_at", F.when(F.col("status") == "canceled", F.col("current_period_end"))))
        c = self.t.customer.filter(F.col("c_mktsegment") == "MACHINERY")  # the segment without a paid plan
        ck = F.col("c_custkey")
        trial_end = add_days_ts(as_of, ((ck % 15) - 1).cast("int"))
        trials = c.select(
            (F.lit(-1) - ck).alias("subscription_id"),
            ck.alias("organization_id"),
            _case(F.col("c_mktsegment"), SEGMENT_TO_PLAN, "starter").alias("plan_id"),
            add_days_ts(as_of, -14).alias("current_period_start"),
            trial_end.alias("current_period_end"),
            trial_end.alias("trial_ends_at"),
            add_days_ts(as_of, -14).alias("created_at"),
            F.lit("trialing").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("canceled_at"))
        cols = ["subscription_id", "organization_id", "plan_id", "status", "trial_ends_at",
                "current_period_start", "current_period_end", "canceled_at", "created_at"]
        return paid.select(cols).unionByName(trials.select(cols))

    # ------------------------------------------------------------- invoices
    @property
    def invoices(self) -> DataFrame:
        o = self.t.orders
        subtotal = F.round(F.col("o_totalprice") * 100).cast("long")
        tax = F.round(F.col("o_totalprice") * 8).cast("long")
        return o.select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("organization_id"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("subscription_id"),
            subtotal.alias("subtotal_cents"),
            tax.alias("tax_cents"),
            (subtotal + tax).alias("total_cents"),
            _case(F.col("o_orderstatus"), INVOICE_STATUS).alias("invoice_status"),
            F.to_date("o_orderdate").alias("period_start"),
            F.date_add(F.to_date("o_orderdate"), 29).alias("period_end"),
            F.when(F.col("o_orderstatus") == "F", add_days_ts("o_orderdate", 3)).alias("paid_at"),
            F.col("o_orderdate").alias("created_at"),
        )

    # -------------------------------------------------------- usage records
    @property
    def usage_records(self) -> DataFrame:
        s = self.sessions
        m = F.trunc(F.to_date("started_at"), "MM")
        return (s.groupBy(F.col("organization_id"), m.alias("period_start"))
                 .agg(F.count(F.lit(1)).alias("sessions_count"),
                      F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0)) / 60.0, 2).alias("session_minutes"),
                      F.sum("bytes_downloaded").alias("bytes_downloaded"),
                      F.sum("bytes_uploaded").alias("bytes_uploaded"),
                      F.sum(F.when(F.col("proxy_type").isNotNull(), 1).otherwise(0)).cast("int").alias("proxy_requests"))
                 .select(F.concat_ws("-", F.col("organization_id").cast("string"),
                                     F.date_format("period_start", "yyyyMM")).alias("usage_record_id"),
                         "organization_id",
                         F.lit(None).cast("long").alias("subscription_id"),
                         "period_start", F.last_day("period_start").alias("period_end"),
                         F.col("sessions_count").cast("int").alias("sessions_count"),
                         "session_minutes", "bytes_downloaded", "bytes_uploaded", "proxy_requests"))

    # --------------------------------------------------------------- api keys
    @property
    def api_keys(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        created = F.date_add(F.lit("1995-01-01").cast("date"), ((k * 37) % 2000).cast("int")).cast("timestamp_ntz")
        return c.select(
            k.alias("api_key_id"), k.alias("organization_id"),
            F.array(F.lit("sessions:read"), F.lit("sessions:write")).alias("scopes"),
            F.when(k % 10 == 0, F.lit("revoked")).otherwise(F.lit("active")).alias("status"),
            created.alias("created_at"))

    # ------------------------------------------------------------ raw events
    @property
    def events(self) -> DataFrame:
        return self.t.events

    # =========================================================== GTM entities
    @property
    def employees(self) -> DataFrame:
        s = self.t.supplier
        k = F.col("s_suppkey")
        return s.select(
            k.alias("employee_id"), F.col("s_name").alias("full_name"),
            F.concat(F.lit("rep"), k.cast("string"), F.lit("@example.com")).alias("employee_email"),
            _case(k % 3, {0: "sales", 1: "marketing", 2: "success"}).alias("team"),
            F.when(k >= 10, k % 10).alias("manager_employee_id"),
            F.lit(True).alias("is_active"))

    @property
    def accounts(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        created = F.date_add(F.lit("1995-01-01").cast("date"), ((k * 37) % 2000).cast("int")).cast("timestamp_ntz")
        return c.select(
            k.alias("account_id"),
            F.when(k % 4 != 3, k).alias("organization_id"),
            F.col("c_name").alias("account_name"),
            F.when(F.col("c_acctbal") >= 5000, F.lit("enterprise")).when(F.col("c_acctbal") >= 0, F.lit("mid_market"))
             .otherwise(F.lit("smb")).alias("account_tier"),
            F.lit("active").alias("account_status"),
            (k % 10).alias("owner_employee_id"),
            F.lower(F.trim("c_mktsegment")).alias("industry"),
            F.when(F.col("c_acctbal") >= 5000, F.lit("201-1000")).when(F.col("c_acctbal") >= 0, F.lit("51-200"))
             .otherwise(F.lit("1-50")).alias("employee_band"),
            F.lit("crm").alias("source_system"),
            add_days_ts(created, -30).alias("created_at"),
            add_days_ts(created, -29).alias("updated_at"))

    @property
    def leads(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        status = _case(k % 5, {0: "new", 1: "working", 2: "nurturing", 3: "qualified", 4: "converted"})
        return o.select(
            k.alias("lead_id"), F.col("o_custkey").alias("account_id"),
            _case(k % 4, {0: "inbound", 1: "outbound", 2: "referral", 3: "partner"}).alias("lead_source"),
            status.alias("lead_status"), (k % 100).cast("int").alias("lead_score"),
            (F.col("o_custkey") % 10).alias("owner_employee_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(k % 5 == 4, add_days_ts("o_orderdate", (k % 30).cast("int"))).alias("converted_at"),
            add_days_ts("o_orderdate", (k % 10).cast("int")).alias("updated_at"))

    @property
    def campaigns(self) -> DataFrame:
        """One campaign per distinct part brand ('Brand#N')."""
        p = self.t.part.select("p_brand").distinct()
        n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
        start = F.date_add(F.lit("1995-01-01").cast("date"), n * 30)
        return p.select(
            F.col("p_brand").alias("campaign_id"),
            F.concat(F.lit("Campaign "), F.col("p_brand")).alias("campaign_name"),
            _case(n % 4, {0: "paid_search", 1: "paid_social", 2: "email", 3: "events"}).alias("channel"),
            (n * 1000).cast("double").alias("budget_usd"),
            start.alias("start_date"), F.date_add(start, 1825).alias("end_date"),
            (n % 10).cast("long").alias("owner_employee_id"))

    @property
    def lead_touches(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
        p = self.t.part.select("p_partkey", "p_brand")
        j = li.join(p, li.l_partkey == p.p_partkey, "left")
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("touch_id"),
            F.col("l_orderkey").alias("lead_id"), F.col("p_brand").alias("campaign_id"),
            _case(F.col("l_linenumber") % 3, {0: "first_touch", 1: "nurture", 2: "last_touch"}).alias("touch_type"),
            F.when(F.col("l_linenumber") % 4 == 0, F.lit(" ")).alias("channel"),
            F.col("l_shipdate").alias("touch_at"), F.col("l_shipdate").alias("created_at"),
            F.concat(F.lit('{"line": '), F.col("l_linenumber").cast("string"), F.lit("}")).alias("metadata"))

    @property
    def opportunities(self) -> DataFrame:
        return self._opportunities(self.t.orders.select("o_orderkey", "o_custkey"))

    def account_opportunities(self, accounts: DataFrame) -> DataFrame:
        """``opportunities`` joined with ``accounts`` by ``account_id``: the same inner joins in
        another order, as the accounts meet the orders, not the many more lines."""
        also = [c for c in accounts.columns if c != "account_id"]
        o = self.t.orders.select("o_orderkey", "o_custkey").join(accounts.withColumnRenamed("account_id", "o_custkey"), "o_custkey")
        return self._opportunities(o, also)

    def _opportunities(self, o: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag",
                                    "l_linestatus", "l_shipdate")
        j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        stage = (F.when(F.col("l_returnflag") == "A", F.lit("closed_won"))
                 .when(F.col("l_returnflag") == "R", F.lit("closed_lost"))
                 .when(F.col("l_linestatus") == "O", F.lit("proposal")).otherwise(F.lit("qualification")))
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("opportunity_id"),
            F.col("o_custkey").alias("account_id"), F.col("l_orderkey").alias("originating_lead_id"),
            stage.alias("stage"), F.col("l_extendedprice").alias("amount_usd"),
            add_days_ts("l_shipdate", -30).alias("created_at"),
            F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_shipdate")).alias("closed_at"),
            (F.col("l_returnflag") == "A").alias("is_won"),
            (F.col("l_suppkey") % 10).alias("owner_employee_id"), *also)

    # Activities replay the event stream shifted so its last day lines up with as_of.
    ACTIVITY_SHIFT_DAYS = -8217

    @property
    def activities(self) -> DataFrame:
        e = self.t.events
        et = F.col("event_type")
        atype = F.when(et.isin("click", "purchase", "error"), F.lit("workflow_execution")) \
                 .when(et == "view", F.lit("email")).otherwise(F.lit("call"))
        subject = F.concat(F.lit("organization_id="), F.col("user_id").cast("string"),
                           F.lit("|action_type="), F.when(et == "purchase", F.lit("send_offer"))
                           .otherwise(F.lit("intervene_trial_conversion")),
                           F.lit("|destination="), F.when(F.col("event_id") % 2 == 0, F.lit("hubspot"))
                           .otherwise(F.lit("slack")),
                           F.when(et == "error", F.lit("|error=delivery_timeout")).otherwise(F.lit("")))
        return e.select(
            F.col("event_id").alias("activity_id"), F.col("user_id").alias("account_id"),
            atype.alias("activity_type"), F.lit("outbound").alias("direction"), subject.alias("subject"),
            F.when(et == "error", F.lit("failed")).otherwise(F.lit("success")).alias("outcome"),
            F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("rep-"), (F.col("user_id") % 10).cast("string")))
             .alias("legacy_owner_user_id"),
            add_days_ts("ts", self.ACTIVITY_SHIFT_DAYS).alias("occurred_at"))

    # ====================================================== finance entities
    # Money is carried in integer cents (``*_cents``) and exposed in USD once.
    @property
    def _lineitem_orders(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
                                    "l_returnflag", "l_linestatus", "l_shipdate")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        return li.join(o, li.l_orderkey == o.o_orderkey, "inner")

    @property
    def fin_departments(self) -> DataFrame:
        c = self.t.customer.select("c_custkey", "c_nationkey")
        n = F.broadcast(self.t.nation.select("n_nationkey", "n_name"))  # fixed 25-row reference table
        k = F.col("c_custkey")
        return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
            k.alias("department_id"), k.alias("organization_id"),
            F.concat(F.col("n_name"), F.lit(" ops")).alias("department_name"),
            ((F.lit(1000) + (k % 10) * 500) * 100).cast("long").alias("budget_cents"),
            F.when(k % 9 == 0, F.lit("inactive")).otherwise(F.lit("active")).alias("department_status"))

    @property
    def fin_vendors(self) -> DataFrame:
        s = self.t.supplier
        k = F.col("s_suppkey")
        return s.select(
            k.alias("vendor_id"), F.col("s_name").alias("vendor_name"),
            _case(k % 4, {0: "software", 1: "travel", 2: "office", 3: "services"}).alias("vendor_category"),
            F.when(k % 2 == 0, F.lit("net30")).otherwise(F.lit("net15")).alias("payment_terms"),
            F.when(F.col("s_acctbal") < 0, F.lit("high")).otherwise(F.lit("low")).alias("risk_level"),
            F.upper(F.trim(F.lit(" us "))).alias("country_code"))

    @property
    def fin_cards(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        return c.select(
            k.alias("card_id"), k.alias("organization_id"),
            F.when(k % 2 == 0, F.lit("visa")).otherwise(F.lit("mastercard")).alias("card_brand"),
            F.when(k % 3 == 0, F.lit("physical")).otherwise(F.lit("virtual")).alias("card_type"),
            F.lit(500000).cast("long").alias("limit_cents"),
            F.when(k % 11 == 0, F.lit("frozen")).otherwise(F.lit("active")).alias("card_status"))

    @property
    def fin_transactions(self) -> DataFrame:
        j = self._lineitem_orders
        status = (F.when(F.col("l_linestatus") == "F", F.lit("cleared"))
                  .when(F.col("l_returnflag") == "R", F.lit("declined")).otherwise(F.lit("posted")))
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
            F.col("o_custkey").alias("organization_id"), F.col("o_custkey").alias("card_id"),
            F.col("l_suppkey").alias("vendor_id"),
            F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) div 10").alias("amount_cents"),
            status.alias("transaction_status"), F.col("l_shipdate").alias("transaction_at"))

    @property
    def fin_reimbursements(self) -> DataFrame:
        o = self.t.orders
        st = F.col("o_orderstatus")
        return o.select(
            F.col("o_orderkey").alias("reimbursement_id"), F.col("o_custkey").alias("organization_id"),
            F.expr("CAST(round(o_totalprice * 100) AS BIGINT) div 100").alias("amount_cents"),
            _case(st, {"F": "paid", "O": "approved", "P": "submitted"}).alias("reimbursement_status"),
            F.col("o_orderdate").alias("submitted_at"),
            F.when(st != "P", add_days_ts("o_orderdate", 2)).alias("approved_at"),
            F.when(st == "F", add_days_ts("o_orderdate", 5)).alias("paid_at"))

    @property
    def fin_bills(self) -> DataFrame:
        o = self.t.orders
        k, st = F.col("o_orderkey"), F.col("o_orderstatus")
        status = (F.when(st == "F", F.lit("paid")).when(st == "O", F.lit("approved"))
                  .when(k % 2 == 0, F.lit("submitted")).otherwise(F.lit("scheduled")))
        return o.select(
            k.alias("bill_id"), F.col("o_custkey").alias("organization_id"), (k % 10).alias("vendor_id"),
            F.to_date("o_orderdate").alias("bill_date"),
            F.when(k % 11 != 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("due_date"),
            F.expr("CAST(round(o_totalprice * 100) AS BIGINT) div 20").alias("amount_cents"),
            status.alias("bill_status"))

    @property
    def fin_bill_payments(self) -> DataFrame:
        o = self.t.orders.filter(F.col("o_orderstatus") == "F")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("bill_payment_id"), k.alias("bill_id"), F.col("o_custkey").alias("organization_id"),
            F.expr("CAST(round(o_totalprice * 100) AS BIGINT) div 20").alias("amount_cents"),
            F.when(k % 13 != 0, add_days_ts("o_orderdate", 20)).alias("paid_at"),
            add_days_ts("o_orderdate", 19).alias("created_at"),
            F.when(k % 19 == 0, F.lit("failed")).otherwise(F.lit("paid")).alias("payment_status"))

    @property
    def fin_bill_adjustments(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        return o.select(
            k.alias("bill_adjustment_id"), k.alias("bill_id"), F.col("o_custkey").alias("organization_id"),
            F.when(k % 2 == 0, F.lit("decrease")).otherwise(F.lit("increase")).alias("direction"),
            ((k % 50) * 100).alias("amount_cents"), add_days_ts("o_orderdate", 10).alias("adjusted_at"))

    @property
    def fin_payment_reversals(self) -> DataFrame:
        j = self._lineitem_orders.filter(F.col("l_returnflag") == "R")
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payment_reversal_id"),
            F.col("l_orderkey").alias("original_payment_id"),
            F.when(F.col("l_linenumber") % 2 == 1, F.col("l_orderkey")).alias("bill_id"),
            F.col("o_custkey").alias("organization_id"),
            F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) div 10").alias("reversal_amount_cents"),
            F.when(F.col("l_linestatus") == "F", F.lit("completed")).otherwise(F.lit("pending")).alias("reversal_status"),
            F.col("l_shipdate").alias("reversed_at"))

    @property
    def contacts(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        return c.select(
            k.alias("contact_id"), k.alias("account_id"),
            F.concat(F.lit("contact"), k.cast("string"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_acctbal") >= 7000, F.lit("executive")).when(F.col("c_acctbal") >= 2000, F.lit("manager"))
             .otherwise(F.lit("individual")).alias("seniority"),
            F.lower(F.trim("c_mktsegment")).alias("lifecycle_stage"))
