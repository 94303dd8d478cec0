"""DuckDB SQL twins of the bindings and data products (oracle side only).

``VIEWS`` maps a view name to ``(sql, deps)``.  ``compose(final, deps)`` emits a
``WITH`` chain containing every transitive dependency in dependency order,
followed by the final SELECT.  The raw tables are pre-registered views in the
driver's DuckDB, so only derived entities appear here.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}

AS_OF_SQL = "DATE '2001-08-01'"
AS_OF_TS_SQL = "TIMESTAMP '2001-08-01 00:00:00'"
EV_AS_OF_SQL = "DATE '2024-01-31'"


def view(name: str, sql: str, *deps: str) -> None:
    VIEWS[name] = (sql.strip(), tuple(deps))


def _order(deps, seen, out):
    for d in deps:
        if d in seen:
            continue
        sql, sub = VIEWS[d]
        _order(sub, seen, out)
        seen.add(d)
        out.append(d)


def spark_round(sql: str) -> str:
    """Rewrite two-argument ``round(x, d)`` to Spark's rounding semantics.

    Spark rounds HALF_UP on the decimal representation of a double, DuckDB on
    its binary value (2.155 -> 2.16 vs 2.15).  Rounding the shortest decimal
    text of the double (``CAST(x AS VARCHAR)``) reproduces Spark's result.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        if comma < 0:
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        inner = spark_round(sql[j + 6:comma])
        digits = sql[comma + 1:k].strip()
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST(CAST(CAST(({inner}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)")
        i = k + 1


def compose(final: str, *deps: str) -> str:
    out: list[str] = []
    _order(deps, set(), out)
    if not out:
        return spark_round(final.strip())
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][0]}\n)" for n in out)
    body = final.strip()
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return spark_round(f"WITH {ctes},\n{body[5:]}")
    return spark_round(f"WITH {ctes}\n{body}")


# ----------------------------------------------------------------- bindings
view("b_plans", """
SELECT plan_id, display_name, monthly_price_usd, sessions_limit_monthly, concurrent_sessions_limit,
       max_session_duration_mins, has_stealth_mode, has_residential_proxies, has_priority_support,
       plan_id AS plan_name
FROM (VALUES
  ('free', 'Free', 0.0::DOUBLE, 100, 2, 5, FALSE, FALSE, FALSE),
  ('starter', 'Starter', 49.0::DOUBLE, 1000, 5, 30, TRUE, FALSE, FALSE),
  ('pro', 'Pro', 199.0::DOUBLE, 10000, 20, 60, TRUE, TRUE, FALSE),
  ('enterprise', 'Enterprise', 999.0::DOUBLE, NULL, 100, 120, TRUE, TRUE, TRUE)
) v(plan_id, display_name, monthly_price_usd, sessions_limit_monthly, concurrent_sessions_limit,
    max_session_duration_mins, has_stealth_mode, has_residential_proxies, has_priority_support)
""")

view("b_plan_economics", """
SELECT plan_economics_id, plan_id, expected_cost_per_hour_usd,
       CAST(effective_start AS TIMESTAMP) AS effective_start, CAST(effective_end AS TIMESTAMP) AS effective_end
FROM (VALUES
  ('pe_free_1', 'free', 0.6::DOUBLE, '1990-01-01 00:00:00', '1998-07-01 00:00:00'),
  ('pe_free_2', 'free', 0.72::DOUBLE, '1998-07-01 00:00:00', NULL),
  ('pe_starter_1', 'starter', 0.95::DOUBLE, '1990-01-01 00:00:00', '1998-07-01 00:00:00'),
  ('pe_starter_2', 'starter', 1.14::DOUBLE, '1998-07-01 00:00:00', NULL),
  ('pe_pro_1', 'pro', 1.45::DOUBLE, '1990-01-01 00:00:00', '1998-07-01 00:00:00'),
  ('pe_pro_2', 'pro', 1.74::DOUBLE, '1998-07-01 00:00:00', NULL),
  ('pe_enterprise_1', 'enterprise', 2.1::DOUBLE, '1990-01-01 00:00:00', '1998-07-01 00:00:00'),
  ('pe_enterprise_2', 'enterprise', 2.52::DOUBLE, '1998-07-01 00:00:00', NULL)
) v(plan_economics_id, plan_id, expected_cost_per_hour_usd, effective_start, effective_end)
""")

view("b_organizations", """
SELECT c_custkey AS organization_id, c_name AS organization_name,
       lower(replace(c_name, '#', '-')) AS organization_slug,
       CASE WHEN c_custkey % 20 = 0 THEN 'churned' WHEN c_custkey % 20 = 1 THEN 'suspended' ELSE 'active' END AS status,
       'cus_' || CAST(c_custkey AS VARCHAR) AS stripe_customer_id,
       'billing+' || CAST(c_custkey AS VARCHAR) || '@example.com' AS billing_email,
       c_mktsegment AS segment, c_nationkey AS nation_id,
       CAST(DATE '1995-01-01' + CAST((c_custkey * 37) % 2000 AS INTEGER) AS TIMESTAMP) AS created_at
FROM customer
""")

view("b_users", """
SELECT user_id, 'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
       CASE WHEN user_id % 3 = 0 THEN 'google' ELSE 'email' END AS auth_provider,
       user_id % 5 <> 0 AS is_email_verified, last_login_at, created_at
FROM (SELECT user_id, min(ts) AS created_at, max(ts) AS last_login_at FROM events GROUP BY user_id)
""")

view("b_members", """
SELECT user_id, user_id % 50 AS organization_id, 'owner' AS role, created_at AS joined_at FROM b_users
UNION ALL
SELECT user_id, (user_id + 1) % 50 AS organization_id, 'member' AS role, created_at + INTERVAL 1 DAY AS joined_at
FROM b_users WHERE user_id % 2 = 0
""", "b_users")

view("b_sessions", """
SELECT o_orderkey AS session_id, o_custkey AS organization_id, o_orderkey % 5 AS project_id,
       o_custkey AS api_key_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'chromium' WHEN '2' THEN 'firefox'
            WHEN '3' THEN 'webkit' WHEN '4' THEN 'chromium' ELSE 'firefox' END AS browser_type,
       CAST(1280 + (o_orderkey % 3) * 320 AS INTEGER) AS viewport_width,
       CAST(720 + (o_orderkey % 2) * 180 AS INTEGER) AS viewport_height,
       CASE WHEN o_orderkey % 4 = 0 THEN 'residential' END AS proxy_type,
       CASE WHEN o_orderkey % 4 = 0 THEN 'US' END AS proxy_country,
       o_orderkey % 3 = 0 AS is_stealth_mode,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' WHEN 'P' THEN 'timeout' END AS status,
       o_orderdate AS started_at,
       o_orderdate + to_seconds(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 30 + (o_orderkey * 7919) % 2700 END) AS ended_at,
       o_orderdate + INTERVAL 3600 SECOND AS timeout_at,
       CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 30 + (o_orderkey * 7919) % 2700 END AS INTEGER) AS duration_seconds,
       'https://app' || CAST(o_custkey % 97 AS VARCHAR) || '.example.com/p/' || CAST(o_orderkey % 13 AS VARCHAR) AS initial_url,
       CAST(1 + o_orderkey % 20 AS INTEGER) AS pages_visited,
       CAST(round(o_totalprice * 100) AS BIGINT) AS bytes_downloaded,
       (o_orderkey * 131) % 100000 AS bytes_uploaded,
       o_orderdate AS created_at
FROM orders
""")

view("b_session_events", """
SELECT l_orderkey * 10 + l_linenumber AS event_id, l_orderkey AS session_id,
       CASE l_returnflag WHEN 'A' THEN 'navigation' WHEN 'N' THEN 'click' WHEN 'R' THEN 'error' END AS event_type,
       '{"line": ' || CAST(l_linenumber AS VARCHAR) || '}' AS event_data,
       l_shipdate AS event_at
FROM lineitem
""")

view("b_subscriptions", f"""
SELECT subscription_id, organization_id, plan_id,
       CASE WHEN current_period_end >= {AS_OF_TS_SQL} THEN 'active' ELSE 'canceled' END AS status,
       trial_ends_at, current_period_start, current_period_end,
       CASE WHEN current_period_end >= {AS_OF_TS_SQL} THEN NULL ELSE current_period_end END AS canceled_at,
       created_at
FROM (
  SELECT o_orderkey AS subscription_id, o_custkey AS organization_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'enterprise' WHEN '2-HIGH' THEN 'pro'
              WHEN '3-MEDIUM' THEN 'starter' WHEN '4-NOT SPECIFIED' THEN 'starter' ELSE 'free' END AS plan_id,
         CAST(NULL AS TIMESTAMP) AS trial_ends_at,
         o_orderdate AS current_period_start,
         CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '2999-12-31 00:00:00' ELSE o_orderdate + INTERVAL 180 DAY END AS current_period_end,
         o_orderdate AS created_at
  FROM orders WHERE o_orderstatus = 'F'
)
UNION ALL
SELECT -1 - c_custkey AS subscription_id, c_custkey AS organization_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'free' WHEN 'BUILDING' THEN 'starter' WHEN 'FURNITURE' THEN 'pro'
            WHEN 'HOUSEHOLD' THEN 'enterprise' ELSE 'starter' END AS plan_id,
       'trialing' AS status,
       {AS_OF_TS_SQL} + to_days(CAST(c_custkey % 15 - 1 AS INTEGER)) AS trial_ends_at,
       {AS_OF_TS_SQL} - INTERVAL 14 DAY AS current_period_start,
       {AS_OF_TS_SQL} + to_days(CAST(c_custkey % 15 - 1 AS INTEGER)) AS current_period_end,
       CAST(NULL AS TIMESTAMP) AS canceled_at,
       {AS_OF_TS_SQL} - INTERVAL 14 DAY AS created_at
FROM customer WHERE c_mktsegment = 'MACHINERY'
""")

view("b_invoices", """
SELECT o_orderkey AS invoice_id, o_custkey AS organization_id,
       CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS subscription_id,
       CAST(round(o_totalprice * 100) AS BIGINT) AS subtotal_cents,
       CAST(round(o_totalprice * 8) AS BIGINT) AS tax_cents,
       CAST(round(o_totalprice * 100) AS BIGINT) + CAST(round(o_totalprice * 8) AS BIGINT) AS total_cents,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'open' WHEN 'P' THEN 'void' END AS invoice_status,
       CAST(o_orderdate AS DATE) AS period_start,
       CAST(CAST(o_orderdate AS DATE) + 29 AS DATE) AS period_end,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS paid_at,
       o_orderdate AS created_at
FROM orders
""")

view("b_usage_records", """
SELECT CAST(organization_id AS VARCHAR) || '-' || strftime(period_start, '%Y%m') AS usage_record_id,
       organization_id, CAST(NULL AS BIGINT) AS subscription_id, period_start,
       CAST(last_day(period_start) AS DATE) AS period_end,
       CAST(sessions_count AS INTEGER) AS sessions_count, session_minutes,
       bytes_downloaded, bytes_uploaded, proxy_requests
FROM (
  SELECT organization_id, CAST(date_trunc('month', started_at) AS DATE) AS period_start,
         count(*) AS sessions_count,
         round(coalesce(sum(duration_seconds), 0) / 60.0, 2) AS session_minutes,
         CAST(sum(bytes_downloaded) AS BIGINT) AS bytes_downloaded,
         CAST(sum(bytes_uploaded) AS BIGINT) AS bytes_uploaded,
         CAST(sum(CASE WHEN proxy_type IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS proxy_requests
  FROM b_sessions GROUP BY 1, 2
)
""", "b_sessions")

view("b_api_keys", """
SELECT c_custkey AS api_key_id, c_custkey AS organization_id,
       ['sessions:read', 'sessions:write'] AS scopes,
       CASE WHEN c_custkey % 10 = 0 THEN 'revoked' ELSE 'active' END AS status,
       CAST(DATE '1995-01-01' + CAST((c_custkey * 37) % 2000 AS INTEGER) AS TIMESTAMP) AS created_at
FROM customer
""")

# ------------------------------------------------------------- GTM bindings
view("b_employees", """
SELECT s_suppkey AS employee_id, s_name AS full_name, 'rep' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS employee_email,
       CASE s_suppkey % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'marketing' WHEN 2 THEN 'success' END AS team,
       CASE WHEN s_suppkey >= 10 THEN s_suppkey % 10 END AS manager_employee_id, TRUE AS is_active
FROM supplier
""")

view("b_accounts", """
SELECT c_custkey AS account_id, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey END AS organization_id,
       c_name AS account_name,
       CASE WHEN c_acctbal >= 5000 THEN 'enterprise' WHEN c_acctbal >= 0 THEN 'mid_market' ELSE 'smb' END AS account_tier,
       'active' AS account_status, c_custkey % 10 AS owner_employee_id,
       lower(trim(c_mktsegment)) AS industry,
       CASE WHEN c_acctbal >= 5000 THEN '201-1000' WHEN c_acctbal >= 0 THEN '51-200' ELSE '1-50' END AS employee_band,
       'crm' AS source_system,
       CAST(DATE '1995-01-01' + CAST((c_custkey * 37) % 2000 AS INTEGER) AS TIMESTAMP) - INTERVAL 30 DAY AS created_at,
       CAST(DATE '1995-01-01' + CAST((c_custkey * 37) % 2000 AS INTEGER) AS TIMESTAMP) - INTERVAL 29 DAY AS updated_at
FROM customer
""")

view("b_leads", """
SELECT o_orderkey AS lead_id, o_custkey AS account_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'inbound' WHEN 1 THEN 'outbound' WHEN 2 THEN 'referral' WHEN 3 THEN 'partner' END AS lead_source,
       CASE o_orderkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'working' WHEN 2 THEN 'nurturing' WHEN 3 THEN 'qualified'
            WHEN 4 THEN 'converted' END AS lead_status,
       CAST(o_orderkey % 100 AS INTEGER) AS lead_score, o_custkey % 10 AS owner_employee_id,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 5 = 4 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS converted_at,
       o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS updated_at
FROM orders
""")

view("b_campaigns", """
SELECT p_brand AS campaign_id, 'Campaign ' || p_brand AS campaign_name,
       CASE n % 4 WHEN 0 THEN 'paid_search' WHEN 1 THEN 'paid_social' WHEN 2 THEN 'email' WHEN 3 THEN 'events' END AS channel,
       CAST(n * 1000 AS DOUBLE) AS budget_usd,
       CAST(DATE '1995-01-01' + n * 30 AS DATE) AS start_date,
       CAST(DATE '1995-01-01' + n * 30 + 1825 AS DATE) AS end_date,
       CAST(n % 10 AS BIGINT) AS owner_employee_id
FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS n FROM part)
""")

view("b_lead_touches", """
SELECT l_orderkey * 10 + l_linenumber AS touch_id, l_orderkey AS lead_id, p.p_brand AS campaign_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'first_touch' WHEN 1 THEN 'nurture' WHEN 2 THEN 'last_touch' END AS touch_type,
       CASE WHEN l_linenumber % 4 = 0 THEN ' ' END AS channel,
       l_shipdate AS touch_at, l_shipdate AS created_at,
       '{"line": ' || CAST(l_linenumber AS VARCHAR) || '}' AS metadata
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
""")

view("b_opportunities", """
SELECT l_orderkey * 10 + l_linenumber AS opportunity_id, o_custkey AS account_id, l_orderkey AS originating_lead_id,
       CASE WHEN l_returnflag = 'A' THEN 'closed_won' WHEN l_returnflag = 'R' THEN 'closed_lost'
            WHEN l_linestatus = 'O' THEN 'proposal' ELSE 'qualification' END AS stage,
       l_extendedprice AS amount_usd, l_shipdate - INTERVAL 30 DAY AS created_at,
       CASE WHEN l_returnflag IN ('A', 'R') THEN l_shipdate END AS closed_at,
       l_returnflag = 'A' AS is_won, l_suppkey % 10 AS owner_employee_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")

view("b_activities", """
SELECT event_id AS activity_id, user_id AS account_id,
       CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'workflow_execution'
            WHEN event_type = 'view' THEN 'email' ELSE 'call' END AS activity_type,
       'outbound' AS direction,
       'organization_id=' || CAST(user_id AS VARCHAR) || '|action_type='
         || CASE WHEN event_type = 'purchase' THEN 'send_offer' ELSE 'intervene_trial_conversion' END
         || '|destination=' || CASE WHEN event_id % 2 = 0 THEN 'hubspot' ELSE 'slack' END
         || CASE WHEN event_type = 'error' THEN '|error=delivery_timeout' ELSE '' END AS subject,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome,
       CASE WHEN user_id % 7 = 0 THEN 'rep-' || CAST(user_id % 10 AS VARCHAR) END AS legacy_owner_user_id,
       ts + INTERVAL (-8217) DAY AS occurred_at
FROM events
""")

# --------------------------------------------------------- finance bindings
view("b_li_orders", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, l_shipdate, o_custkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")

view("b_fin_departments", """
SELECT c_custkey AS department_id, c_custkey AS organization_id, n_name || ' ops' AS department_name,
       CAST((1000 + (c_custkey % 10) * 500) * 100 AS BIGINT) AS budget_cents,
       CASE WHEN c_custkey % 9 = 0 THEN 'inactive' ELSE 'active' END AS department_status
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")

view("b_fin_vendors", """
SELECT s_suppkey AS vendor_id, s_name AS vendor_name,
       CASE s_suppkey % 4 WHEN 0 THEN 'software' WHEN 1 THEN 'travel' WHEN 2 THEN 'office' WHEN 3 THEN 'services' END AS vendor_category,
       CASE WHEN s_suppkey % 2 = 0 THEN 'net30' ELSE 'net15' END AS payment_terms,
       CASE WHEN s_acctbal < 0 THEN 'high' ELSE 'low' END AS risk_level, upper(trim(' us ')) AS country_code
FROM supplier
""")

view("b_fin_cards", """
SELECT c_custkey AS card_id, c_custkey AS organization_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'visa' ELSE 'mastercard' END AS card_brand,
       CASE WHEN c_custkey % 3 = 0 THEN 'physical' ELSE 'virtual' END AS card_type,
       CAST(500000 AS BIGINT) AS limit_cents,
       CASE WHEN c_custkey % 11 = 0 THEN 'frozen' ELSE 'active' END AS card_status
FROM customer
""")

view("b_fin_transactions", """
SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey AS organization_id, o_custkey AS card_id,
       l_suppkey AS vendor_id, CAST(round(l_extendedprice * 100) AS BIGINT) // 10 AS amount_cents,
       CASE WHEN l_linestatus = 'F' THEN 'cleared' WHEN l_returnflag = 'R' THEN 'declined' ELSE 'posted' END AS transaction_status,
       l_shipdate AS transaction_at
FROM b_li_orders
""", "b_li_orders")

view("b_fin_reimbursements", """
SELECT o_orderkey AS reimbursement_id, o_custkey AS organization_id,
       CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS amount_cents,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'approved' WHEN 'P' THEN 'submitted' END AS reimbursement_status,
       o_orderdate AS submitted_at,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 2 DAY END AS approved_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 5 DAY END AS paid_at
FROM orders
""")

view("b_fin_bills", """
SELECT o_orderkey AS bill_id, o_custkey AS organization_id, o_orderkey % 10 AS vendor_id,
       CAST(o_orderdate AS DATE) AS bill_date,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) END AS due_date,
       CAST(round(o_totalprice * 100) AS BIGINT) // 20 AS amount_cents,
       CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'approved'
            WHEN o_orderkey % 2 = 0 THEN 'submitted' ELSE 'scheduled' END AS bill_status
FROM orders
""")

view("b_fin_bill_payments", """
SELECT o_orderkey AS bill_payment_id, o_orderkey AS bill_id, o_custkey AS organization_id,
       CAST(round(o_totalprice * 100) AS BIGINT) // 20 AS amount_cents,
       CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + INTERVAL 20 DAY END AS paid_at,
       o_orderdate + INTERVAL 19 DAY AS created_at,
       CASE WHEN o_orderkey % 19 = 0 THEN 'failed' ELSE 'paid' END AS payment_status
FROM orders WHERE o_orderstatus = 'F'
""")

view("b_fin_bill_adjustments", """
SELECT o_orderkey AS bill_adjustment_id, o_orderkey AS bill_id, o_custkey AS organization_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'decrease' ELSE 'increase' END AS direction,
       (o_orderkey % 50) * 100 AS amount_cents, o_orderdate + INTERVAL 10 DAY AS adjusted_at
FROM orders
""")

view("b_fin_payment_reversals", """
SELECT l_orderkey * 10 + l_linenumber AS payment_reversal_id, l_orderkey AS original_payment_id,
       CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey END AS bill_id, o_custkey AS organization_id,
       CAST(round(l_extendedprice * 100) AS BIGINT) // 10 AS reversal_amount_cents,
       CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS reversal_status,
       l_shipdate AS reversed_at
FROM b_li_orders WHERE l_returnflag = 'R'
""", "b_li_orders")

view("b_contacts", """
SELECT c_custkey AS contact_id, c_custkey AS account_id, 'contact' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       CASE WHEN c_acctbal >= 7000 THEN 'executive' WHEN c_acctbal >= 2000 THEN 'manager' ELSE 'individual' END AS seniority,
       lower(trim(c_mktsegment)) AS lifecycle_stage
FROM customer
""")
