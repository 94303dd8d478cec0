"""Finance operations: spend facts (cards, reimbursements, bills, payments,
adjustments, reversals) and the spend / vendor / budget marts.

Amounts are summed as integer cents and converted to USD once, so every sum is
exact and independent of row order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import month_start
from ..operators.shapes import gap_filled
from .core import dim_organizations, dim_time
from .oracle_views import view
from .registry import register


def _usd(c) -> F.Column:
    return (F.col(c) / 100.0) if isinstance(c, str) else (c / 100.0)


# ------------------------------------------------------------ dims and facts
def dim_fin_departments(b) -> DataFrame:
    d = b.fin_departments
    return d.select("department_id", "organization_id", "department_name", _usd("budget_cents").alias("budget_usd"),
                    "budget_cents", "department_status")


def dim_fin_vendors(b) -> DataFrame:
    return b.fin_vendors


def dim_fin_cards(b) -> DataFrame:
    c = b.fin_cards
    return c.select("card_id", "organization_id", "card_brand", "card_type", _usd("limit_cents").alias("limit_usd"),
                    "card_status")


def fct_fin_transactions(b) -> DataFrame:
    t = b.fin_transactions
    return t.select("transaction_id", "organization_id", "card_id", "vendor_id", "amount_cents",
                    _usd("amount_cents").alias("amount_usd"), "transaction_status", "transaction_at",
                    F.to_date("transaction_at").alias("transaction_date"),
                    month_start("transaction_at").alias("transaction_month"))


def fct_fin_reimbursements(b) -> DataFrame:
    r = b.fin_reimbursements
    return r.select("reimbursement_id", "organization_id", "amount_cents", _usd("amount_cents").alias("amount_usd"),
                    "reimbursement_status", "submitted_at", "approved_at", "paid_at",
                    F.to_date("submitted_at").alias("submitted_date"), month_start("submitted_at").alias("submitted_month"))


def fct_fin_bills(b) -> DataFrame:
    x = b.fin_bills
    return x.select("bill_id", "organization_id", "vendor_id", "bill_date", "due_date", "amount_cents",
                    _usd("amount_cents").alias("amount_usd"), "bill_status", month_start("bill_date").alias("bill_month"))


def fct_fin_bill_payments(b) -> DataFrame:
    p = b.fin_bill_payments
    return p.select("bill_payment_id", "bill_id", "organization_id", "amount_cents",
                    _usd("amount_cents").alias("amount_usd"), "paid_at", "created_at", "payment_status",
                    month_start(F.coalesce("paid_at", "created_at")).alias("paid_month"))


def fct_fin_bill_adjustments(b) -> DataFrame:
    a = b.fin_bill_adjustments
    signed = F.when(F.col("direction") == "decrease", -F.col("amount_cents")).otherwise(F.col("amount_cents"))
    return a.select("bill_adjustment_id", "bill_id", "organization_id", "direction", "amount_cents",
                    _usd("amount_cents").alias("amount_usd"), signed.alias("signed_amount_cents"),
                    _usd(signed).alias("signed_amount_usd"), "adjusted_at",
                    month_start("adjusted_at").alias("adjusted_month"))


def fct_fin_payment_reversals(b) -> DataFrame:
    r = b.fin_payment_reversals
    return r.select("payment_reversal_id", F.col("original_payment_id").alias("bill_payment_id"), "bill_id",
                    "organization_id", "reversal_amount_cents",
                    _usd("reversal_amount_cents").alias("reversal_amount_usd"), "reversal_status", "reversed_at",
                    F.to_date("reversed_at").alias("reversed_date"), month_start("reversed_at").alias("reversed_month"))


view("dim_fin_departments", "SELECT department_id, organization_id, department_name, budget_cents / 100.0 AS budget_usd, "
     "budget_cents, department_status FROM b_fin_departments", "b_fin_departments")
view("dim_fin_vendors", "SELECT * FROM b_fin_vendors", "b_fin_vendors")
view("dim_fin_cards", "SELECT card_id, organization_id, card_brand, card_type, limit_cents / 100.0 AS limit_usd, card_status "
     "FROM b_fin_cards", "b_fin_cards")
view("fct_fin_transactions", """
SELECT transaction_id, organization_id, card_id, vendor_id, amount_cents, amount_cents / 100.0 AS amount_usd,
       transaction_status, transaction_at, CAST(transaction_at AS DATE) AS transaction_date,
       CAST(date_trunc('month', transaction_at) AS DATE) AS transaction_month
FROM b_fin_transactions""", "b_fin_transactions")
view("fct_fin_reimbursements", """
SELECT reimbursement_id, organization_id, amount_cents, amount_cents / 100.0 AS amount_usd, reimbursement_status,
       submitted_at, approved_at, paid_at, CAST(submitted_at AS DATE) AS submitted_date,
       CAST(date_trunc('month', submitted_at) AS DATE) AS submitted_month
FROM b_fin_reimbursements""", "b_fin_reimbursements")
view("fct_fin_bills", """
SELECT bill_id, organization_id, vendor_id, bill_date, due_date, amount_cents, amount_cents / 100.0 AS amount_usd,
       bill_status, CAST(date_trunc('month', bill_date) AS DATE) AS bill_month
FROM b_fin_bills""", "b_fin_bills")
view("fct_fin_bill_payments", """
SELECT bill_payment_id, bill_id, organization_id, amount_cents, amount_cents / 100.0 AS amount_usd, paid_at, created_at,
       payment_status, CAST(date_trunc('month', coalesce(paid_at, created_at)) AS DATE) AS paid_month
FROM b_fin_bill_payments""", "b_fin_bill_payments")
view("fct_fin_bill_adjustments", """
SELECT bill_adjustment_id, bill_id, organization_id, direction, amount_cents, amount_cents / 100.0 AS amount_usd,
       CASE WHEN direction = 'decrease' THEN -amount_cents ELSE amount_cents END AS signed_amount_cents,
       CASE WHEN direction = 'decrease' THEN -amount_cents ELSE amount_cents END / 100.0 AS signed_amount_usd,
       adjusted_at, CAST(date_trunc('month', adjusted_at) AS DATE) AS adjusted_month
FROM b_fin_bill_adjustments""", "b_fin_bill_adjustments")
view("fct_fin_payment_reversals", """
SELECT payment_reversal_id, original_payment_id AS bill_payment_id, bill_id, organization_id, reversal_amount_cents,
       reversal_amount_cents / 100.0 AS reversal_amount_usd, reversal_status, reversed_at,
       CAST(reversed_at AS DATE) AS reversed_date, CAST(date_trunc('month', reversed_at) AS DATE) AS reversed_month
FROM b_fin_payment_reversals""", "b_fin_payment_reversals")

for _name, _fn, _src in [
    ("dim_fin_departments", dim_fin_departments, "stg_finance_departments"),
    ("dim_fin_vendors", dim_fin_vendors, "stg_finance_vendors"),
    ("dim_fin_cards", dim_fin_cards, "stg_finance_cards"),
    ("fct_fin_transactions", fct_fin_transactions, "stg_finance_transactions"),
    ("fct_fin_reimbursements", fct_fin_reimbursements, "stg_finance_reimbursements"),
    ("fct_fin_bills", fct_fin_bills, "stg_finance_bills"),
    ("fct_fin_bill_payments", fct_fin_bill_payments, "stg_finance_bill_payments"),
    ("fct_fin_bill_adjustments", fct_fin_bill_adjustments, "stg_finance_bill_adjustments"),
    ("fct_fin_payment_reversals", fct_fin_payment_reversals, "stg_finance_payment_reversals"),
]:
    register(_name, f"SELECT * FROM {_name}", (_name,), inputs=(_src,))(_fn)


# --------------------------------------------------------- spend components
POSTED = ("posted", "cleared")
REIMBURSED = ("approved", "paid")
OPEN_AP = ("submitted", "approved", "scheduled")


def _card_spend(t: DataFrame, keys) -> DataFrame:
    return t.groupBy(*keys).agg(
        F.sum(F.when(F.col("transaction_status").isin(*POSTED), F.col("amount_cents")).otherwise(0)).alias("_c"),
        F.count(F.lit(1)).alias("record_count"))


def _reimb_month(r: DataFrame):
    return month_start(F.coalesce("paid_at", "approved_at", "submitted_at"))


def fin_spend_monthly(b) -> DataFrame:
    """Org x month x source spend; bill payments net of same-month reversals."""
    t = fct_fin_transactions(b).withColumnRenamed("transaction_month", "spend_month")
    card = _card_spend(t, ["organization_id", "spend_month"]).withColumn("spend_source", F.lit("card_transaction"))
    r = fct_fin_reimbursements(b)
    reimb = (r.groupBy("organization_id", _reimb_month(r).alias("spend_month"))
             .agg(F.sum(F.when(F.col("reimbursement_status").isin(*REIMBURSED), F.col("amount_cents")).otherwise(0))
                  .alias("_c"), F.count(F.lit(1)).alias("record_count"))
             .withColumn("spend_source", F.lit("reimbursement")))
    p = fct_fin_bill_payments(b)
    paid = (p.groupBy("organization_id", F.col("paid_month").alias("spend_month"))
            .agg(F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_cents")).otherwise(0)).alias("_g"),
                 F.count(F.lit(1)).alias("record_count")))
    rv = fct_fin_payment_reversals(b)
    rev = (rv.groupBy("organization_id", F.col("reversed_month").alias("spend_month"))
           .agg(F.sum(F.when(F.col("reversal_status") == "completed", F.col("reversal_amount_cents")).otherwise(0))
                .alias("_r")))
    net = (paid.join(rev, ["organization_id", "spend_month"], "left")
           .select("organization_id", "spend_month", (F.col("_g") - F.coalesce("_r", F.lit(0))).alias("_c"),
                   "record_count", F.lit("bill_payment").alias("spend_source")))
    cols = ["organization_id", "spend_month", "spend_source", "_c", "record_count"]
    u = card.select(cols).unionByName(reimb.select(cols)).unionByName(net.select(cols))
    return u.select("organization_id", "spend_month", "spend_source", _usd("_c").alias("spend_usd"), "record_count")


view("fin_spend_monthly", """
WITH moved AS (  -- every movement that spends or takes back; a reversal is no record
  SELECT organization_id, transaction_month AS spend_month, 'card_transaction' AS spend_source, if(transaction_status IN ('posted', 'cleared'), amount_cents, 0) AS cents, 1 AS n
  FROM fct_fin_transactions
  UNION ALL SELECT organization_id, CAST(date_trunc('month', coalesce(paid_at, approved_at, submitted_at)) AS DATE), 'reimbursement',
            if(reimbursement_status IN ('approved', 'paid'), amount_cents, 0), 1 FROM fct_fin_reimbursements
  UNION ALL SELECT organization_id, paid_month, 'bill_payment', if(payment_status = 'paid', amount_cents, 0), 1 FROM fct_fin_bill_payments
  UNION ALL SELECT organization_id, reversed_month, 'bill_payment', if(reversal_status = 'completed', -reversal_amount_cents, 0), 0 FROM fct_fin_payment_reversals)
SELECT organization_id, spend_month, spend_source, sum(cents) / 100.0 AS spend_usd, CAST(sum(n) AS BIGINT) AS record_count
FROM moved GROUP BY ALL HAVING sum(n) > 0  -- reversals alone make no month
""", "fct_fin_transactions", "fct_fin_reimbursements", "fct_fin_bill_payments", "fct_fin_payment_reversals")
register("fin_spend_monthly", "SELECT * FROM fin_spend_monthly", ("fin_spend_monthly",),
         inputs=("fct_fin_transactions", "fct_fin_reimbursements", "fct_fin_bill_payments",
                 "fct_fin_payment_reversals"))(fin_spend_monthly)


def fin_vendor_spend_monthly(b) -> DataFrame:
    """Org x vendor x month: card spend + bill payments net of reversals.

    Reversals reach a vendor through their bill (own bill id, else the bill
    of the reversed payment); a reversal without a same-month payment for
    that vendor is not counted (as in the source model).
    """
    t = fct_fin_transactions(b)
    txn = (t.groupBy("organization_id", "vendor_id", F.col("transaction_month").alias("spend_month"))
           .agg(F.sum(F.when(F.col("transaction_status").isin(*POSTED), F.col("amount_cents")).otherwise(0)).alias("_c")))
    p = fct_fin_bill_payments(b)
    bills = fct_fin_bills(b).select("bill_id", "vendor_id")
    paid = (p.join(bills, "bill_id", "left")
            .groupBy("organization_id", "vendor_id", F.col("paid_month").alias("spend_month"))
            .agg(F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_cents")).otherwise(0)).alias("_g")))
    rv = fct_fin_payment_reversals(b).alias("r")
    pp = p.select(F.col("bill_payment_id").alias("_pid"), F.col("organization_id").alias("_porg"),
                  F.col("bill_id").alias("_pbill"))
    enr = (rv.join(pp, (F.col("r.bill_payment_id") == F.col("_pid")) & (F.col("r.organization_id") == F.col("_porg")),
                   "left")
           .groupBy(F.col("r.organization_id").alias("organization_id"),
                    F.coalesce(F.col("r.bill_id"), F.col("_pbill")).alias("bill_id"),
                    F.col("r.reversed_month").alias("spend_month"))
           .agg(F.sum(F.when(F.col("r.reversal_status") == "completed", F.col("r.reversal_amount_cents")).otherwise(0))
                .alias("_r")))
    by_vendor = (enr.join(bills, "bill_id", "left").groupBy("organization_id", "vendor_id", "spend_month")
                 .agg(F.sum("_r").alias("_r")))
    keys = ["organization_id", "vendor_id", "spend_month"]
    net = (paid.join(by_vendor, [paid[k].eqNullSafe(by_vendor[k]) for k in keys], "left")
           .select(*[paid[k] for k in keys], (F.col("_g") - F.coalesce("_r", F.lit(0))).alias("_c")))
    u = txn.select(*keys, "_c").unionByName(net)
    agg = u.groupBy(*keys).agg(F.sum("_c").alias("_c"))
    v = dim_fin_vendors(b).select("vendor_id", "vendor_name")
    return (agg.join(v, "vendor_id", "left")
            .select("organization_id", "vendor_id", F.coalesce("vendor_name", F.lit("unknown_vendor")).alias("vendor_name"),
                    "spend_month", _usd("_c").alias("total_spend_usd")))


view("fin_vendor_spend_monthly", """
WITH vendor_of AS MATERIALIZED (SELECT bill_id, vendor_id FROM fct_fin_bills),
moved AS (  -- purchases; bill payments; what comes back by way of the bill of the reversal or of its payment
  SELECT organization_id, vendor_id, transaction_month AS spend_month, if(transaction_status IN ('posted', 'cleared'), amount_cents, 0) AS spent, 0 AS back, 0 AS payments, 1 AS buys
  FROM fct_fin_transactions
  UNION ALL SELECT organization_id, (SELECT any_value(vendor_id) FROM vendor_of v WHERE v.bill_id = p.bill_id), paid_month, if(payment_status = 'paid', amount_cents, 0), 0, 1, 0
  FROM fct_fin_bill_payments p
  UNION ALL SELECT organization_id, (SELECT any_value(vendor_id) FROM vendor_of v WHERE v.bill_id = ifnull(r.bill_id,
              (SELECT any_value(bill_id) FROM fct_fin_bill_payments p WHERE p.bill_payment_id = r.bill_payment_id AND p.organization_id = r.organization_id))),
            reversed_month, 0, if(reversal_status = 'completed', reversal_amount_cents, 0), 0, 0 FROM fct_fin_payment_reversals r),
netted AS (SELECT organization_id, vendor_id, spend_month, sum(spent) - if(sum(payments) > 0, sum(back), 0) AS cents FROM moved GROUP BY 1, 2, 3 HAVING sum(payments) + sum(buys) > 0)
SELECT organization_id, vendor_id, ifnull((SELECT any_value(vendor_name) FROM dim_fin_vendors d WHERE d.vendor_id = netted.vendor_id), 'unknown_vendor') AS vendor_name,
       spend_month, cents / 100.0 AS total_spend_usd
FROM netted
""", "fct_fin_transactions", "fct_fin_bill_payments", "fct_fin_bills", "fct_fin_payment_reversals", "dim_fin_vendors")
register("fin_vendor_spend_monthly", "SELECT * FROM fin_vendor_spend_monthly", ("fin_vendor_spend_monthly",),
         inputs=("fct_fin_transactions", "fct_fin_bill_payments", "fct_fin_bills", "fct_fin_payment_reversals",
                 "dim_fin_vendors"))(fin_vendor_spend_monthly)


# ------------------------------------------------------ budget vs actual
BUDGET_FACTS = ("_card", "_reimb", "_bp", "_adj", "_ap")


def budget_facts(b) -> DataFrame:
    """``organization_id, month`` and the cents of ``BUDGET_FACTS``, unsummed: card spend,
    reimbursements, net bill payments, bill adjustments and open payables."""
    t, r, bills, adj = fct_fin_transactions(b), fct_fin_reimbursements(b), fct_fin_bills(b), fct_fin_bill_adjustments(b)
    # As written in the source model: payments joined to reversals before the
    # sum (a payment with several reversals is counted once per reversal).
    p = fct_fin_bill_payments(b).alias("p")
    rv = fct_fin_payment_reversals(b).select(F.col("bill_payment_id").alias("_rp"), F.col("organization_id").alias("_ro"),
                                             "reversal_status", "reversal_amount_cents")
    paid = p.join(rv, (F.col("p.bill_payment_id") == F.col("_rp")) & (F.col("p.organization_id") == F.col("_ro")), "left")
    when = lambda cond, cents="amount_cents": F.coalesce(F.when(cond, F.col(cents)), F.lit(0)).cast("long")
    parts = [
        t.select("organization_id", F.col("transaction_month").alias("month"), when(F.col("transaction_status").isin(*POSTED)).alias("_card")),
        r.select("organization_id", _reimb_month(r).alias("month"), when(F.col("reimbursement_status").isin(*REIMBURSED)).alias("_reimb")),
        paid.select(F.col("p.organization_id").alias("organization_id"), F.col("p.paid_month").alias("month"),
                    (when(F.col("payment_status") == "paid") - when(F.col("reversal_status") == "completed", "reversal_amount_cents")).alias("_bp")),
        adj.select("organization_id", F.col("adjusted_month").alias("month"), F.col("signed_amount_cents").cast("long").alias("_adj"),
                   F.col("signed_amount_cents").cast("long").alias("_ap")),
        bills.select("organization_id", month_start(F.coalesce("due_date", "bill_date")).alias("month"), when(F.col("bill_status").isin(*OPEN_AP)).alias("_ap")),
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def department_budgets(b) -> DataFrame:
    """``organization_id, _budget``: cents of the active departments."""
    d = dim_fin_departments(b).filter(F.col("department_status") == "active")
    return d.groupBy("organization_id").agg(F.sum(F.coalesce("budget_cents", F.lit(0))).alias("_budget"))


def budget_columns(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The budget figures of a month from its ``BUDGET_FACTS`` and ``_budget``; ``of`` gives a fact's value."""
    z = lambda x: F.coalesce(of(x), F.lit(0))
    actual = z("_card") + z("_reimb") + z("_bp")
    return {
        "budget_allocated_usd": _usd(z("_budget")), "card_spend_usd": _usd(z("_card")),
        "reimbursement_spend_usd": _usd(z("_reimb")), "bill_payment_spend_usd": _usd(z("_bp")),
        "bill_adjustment_net_usd": _usd(z("_adj")), "actual_spend_usd": _usd(actual),
        "budget_variance_usd": _usd(z("_budget") - actual),
        "budget_utilization_ratio": F.round(actual.cast("double") / F.nullif(z("_budget"), F.lit(0)).cast("double"), 4),
        "ap_open_usd": _usd(z("_ap")),
    }


def fin_budget_vs_actual(b) -> DataFrame:
    """Dense org x month grid of budget, spends, adjustments and open AP.

    All movements are stacked and summed once by (organisation, month); months
    without any are filled in behind the last exchange.  Budgets are
    per-organisation constants.
    """
    cal = dim_time(b)
    m0, m1 = cal.agg(F.min("month_start")).scalar(), cal.agg(F.max("month_start")).scalar()  # scalar subqueries
    orgs = b.organizations.select("organization_id", m0.alias("month"), m0.alias("__start"))  # one row per organisation, as in the dimension
    rows = budget_facts(b).unionByName(orgs, allowMissingColumns=True)
    sparse = rows.groupBy("organization_id", "month").agg(*[F.sum(c).alias(c) for c in BUDGET_FACTS], F.max("__start").alias("__start"))
    until = F.least(m1, F.trunc(F.lit(b.as_of).cast("date"), "MM"))
    c = gap_filled(sparse.join(department_budgets(b), "organization_id", "left"), "organization_id", "month", until, "MONTH", own=BUDGET_FACTS, same=["_budget"])
    return c.select("organization_id", F.col("month").alias("budget_month"), *[e.alias(n) for n, e in budget_columns().items()])


view("fin_budget_vs_actual", """
WITH entries AS (  -- signed cents by purpose; 'cell' opens a month for an organisation
  SELECT organization_id, unnest(generate_series((SELECT min(month_start) FROM dim_time), DATE '2001-08-01', INTERVAL 1 MONTH))::DATE AS budget_month,
         'cell' AS what, 0::HUGEINT AS cents FROM (SELECT DISTINCT organization_id FROM dim_organizations)
  UNION ALL SELECT organization_id, transaction_month, 'card', amount_cents FROM fct_fin_transactions WHERE transaction_status IN ('posted', 'cleared')
  UNION ALL SELECT organization_id, CAST(date_trunc('month', coalesce(paid_at, approved_at, submitted_at)) AS DATE), 'own', amount_cents
  FROM fct_fin_reimbursements WHERE reimbursement_status IN ('approved', 'paid')
  UNION ALL  -- a payment counts once for each of its reversals, and once if it has none
  SELECT p.organization_id, p.paid_month, 'bill', if(p.payment_status = 'paid', p.amount_cents, 0)
         * greatest(1, (SELECT count(*) FROM fct_fin_payment_reversals r WHERE r.bill_payment_id = p.bill_payment_id AND r.organization_id = p.organization_id))
  FROM fct_fin_bill_payments p
  UNION ALL SELECT p.organization_id, p.paid_month, 'bill', -r.reversal_amount_cents
  FROM fct_fin_payment_reversals r JOIN fct_fin_bill_payments p USING (bill_payment_id, organization_id) WHERE r.reversal_status = 'completed'
  UNION ALL SELECT organization_id, adjusted_month, unnest(['adjust', 'open']), signed_amount_cents FROM fct_fin_bill_adjustments
  UNION ALL SELECT organization_id, CAST(date_trunc('month', coalesce(due_date, bill_date)) AS DATE), 'open', amount_cents
  FROM fct_fin_bills WHERE bill_status IN ('submitted', 'approved', 'scheduled')),
cells AS (
  SELECT organization_id, budget_month, ifnull(sum(cents) FILTER (what = 'card'), 0) AS card, ifnull(sum(cents) FILTER (what = 'own'), 0) AS own,
         ifnull(sum(cents) FILTER (what = 'bill'), 0) AS bill, ifnull(sum(cents) FILTER (what = 'adjust'), 0) AS adjust,
         ifnull(sum(cents) FILTER (what = 'open'), 0) AS open_ap
  FROM entries GROUP BY 1, 2 HAVING bool_or(what = 'cell')),
planned AS (
  SELECT cells.*, card + own + bill AS spent,
         ifnull((SELECT sum(budget_cents) FROM dim_fin_departments d
                 WHERE d.organization_id = cells.organization_id AND department_status = 'active'), 0) AS plan FROM cells)
SELECT organization_id, budget_month, plan / 100.0 AS budget_allocated_usd, card / 100.0 AS card_spend_usd, own / 100.0 AS reimbursement_spend_usd,
       bill / 100.0 AS bill_payment_spend_usd, adjust / 100.0 AS bill_adjustment_net_usd, spent / 100.0 AS actual_spend_usd,
       (plan - spent) / 100.0 AS budget_variance_usd, round(spent::DOUBLE / nullif(plan::DOUBLE, 0), 4) AS budget_utilization_ratio,
       open_ap / 100.0 AS ap_open_usd
FROM planned
""", "dim_time", "dim_organizations", "dim_fin_departments", "fct_fin_transactions", "fct_fin_reimbursements",
     "fct_fin_bill_payments", "fct_fin_payment_reversals", "fct_fin_bill_adjustments", "fct_fin_bills")
register("fin_budget_vs_actual", "SELECT * FROM fin_budget_vs_actual", ("fin_budget_vs_actual",),
         inputs=("dim_time", "dim_organizations", "dim_fin_departments", "fct_fin_transactions",
                 "fct_fin_reimbursements", "fct_fin_bill_payments", "fct_fin_payment_reversals",
                 "fct_fin_bill_adjustments", "fct_fin_bills"))(fin_budget_vs_actual)
