"""Catalog, monitoring and governance queries that read the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources.tables import TABLE_NAMES
from .core import dim_organizations
from .growth import gtm_action_log, gtm_task_execution
from .oracle_views import AS_OF_TS_SQL
from .quality_q import dq_freshness
from .registry import register

SEARCH_TERM = "ring"
SEARCH_LIMIT = 50


def _cat_tables_sql():
    from ..sources.tables import SCHEMAS
    parts = []
    for t in TABLE_NAMES:
        fc = C.freshness_column(SCHEMAS[t])
        mx = f"CAST(max({fc}) AS TIMESTAMP)" if fc else "CAST(NULL AS TIMESTAMP)"
        fcs = f"'{fc}'" if fc else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(SCHEMAS[t].fields)} AS column_count, "
                     f"{fcs} AS freshness_column, {mx} AS max_freshness, 'data-platform' AS owner, "
                     f"{'TRUE' if t in ('orders', 'lineitem', 'customer') else 'FALSE'} AS is_certified FROM {t}")
    return "\nUNION ALL\n".join(parts)


@register("cat_tables", _cat_tables_sql())
def cat_tables(b):
    return C.table_catalog({t: b.t.scan(t) for t in TABLE_NAMES}, certified=("orders", "lineitem", "customer"))


@register("cat_search", f"""SELECT * FROM (
  SELECT 'customer' AS match_kind, c_custkey AS object_id, c_name AS label FROM customer WHERE contains(c_name, '{SEARCH_TERM}')
  UNION ALL SELECT 'document', doc_id, source FROM documents WHERE contains(text, '{SEARCH_TERM}')
  UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE contains(p_name, '{SEARCH_TERM}'))
ORDER BY match_kind, object_id LIMIT {SEARCH_LIMIT}""")
def cat_search(b):
    t = b.t
    sources = [("part", t.part, "p_partkey", F.col("p_name"), F.col("p_name")),
               ("customer", t.customer, "c_custkey", F.col("c_name"), F.col("c_name")),
               ("document", t.documents, "doc_id", F.col("text"), F.col("source"))]
    return C.search(sources, SEARCH_TERM, SEARCH_LIMIT)


@register("mon_overview", f"""SELECT layer, count(*) AS tables, CAST(sum(CASE WHEN is_stale THEN 1 ELSE 0 END) AS BIGINT) AS stale_tables,
       max(age_hours) AS max_age_hours, CAST(sum(row_count) AS BIGINT) AS total_rows FROM (
SELECT layer, row_count, round(date_diff('second', max_ts, {AS_OF_TS_SQL}) / 3600.0, 2) AS age_hours,
       row_count = 0 OR max_ts IS NULL OR round(date_diff('second', max_ts, {AS_OF_TS_SQL}) / 3600.0, 2) > threshold_hours AS is_stale
FROM (SELECT 'bronze' AS layer, max(o_orderdate) AS max_ts, count(*) AS row_count, 24.0 AS threshold_hours FROM orders
      UNION ALL SELECT 'bronze', max(l_shipdate), count(*), 24.0 FROM lineitem
      UNION ALL SELECT 'silver', max(created_at), count(*), 24.0 FROM fct_sessions
      UNION ALL SELECT 'gold', CAST(max(revenue_month) AS TIMESTAMP), count(*), 48.0 FROM fin_monthly_revenue))
GROUP BY layer""", ("fct_sessions", "fin_monthly_revenue"))
def mon_overview(b):
    f = dq_freshness(b)
    return f.groupBy("layer").agg(F.count(F.lit(1)).alias("tables"),
                                  F.sum(F.when(F.col("is_stale"), 1).otherwise(0)).alias("stale_tables"),
                                  F.max("age_hours").alias("max_age_hours"), F.sum("row_count").alias("total_rows"))


@register("gov_audit_summary", """SELECT source_table, actor_type, actor_id, status, count(*) AS events,
       min(executed_at) AS first_event_at, max(executed_at) AS last_event_at FROM (
  SELECT 'action_log' AS source_table, actor_type, actor_id, status, executed_at FROM gtm_action_log
  UNION ALL SELECT 'task_execution', actor_type, actor_id, status, executed_at FROM gtm_task_execution)
GROUP BY 1, 2, 3, 4""", ("gtm_action_log", "gtm_task_execution"))
def gov_audit_summary(b):
    cols = ["actor_type", "actor_id", "status", "executed_at"]
    a = gtm_action_log(b).select(F.lit("action_log").alias("source_table"), *cols)
    t = gtm_task_execution(b).select(F.lit("task_execution").alias("source_table"), *cols)
    return a.unionByName(t).groupBy("source_table", "actor_type", "actor_id", "status").agg(
        F.count(F.lit(1)).alias("events"), F.min("executed_at").alias("first_event_at"),
        F.max("executed_at").alias("last_event_at"))


@register("gov_mask_sensitive", """SELECT organization_id, sha256(organization_name) AS organization_name,
       CAST(NULL AS VARCHAR) AS stripe_customer_id, sha256(billing_email) AS billing_email, organization_status,
       current_plan_name FROM dim_organizations""", ("dim_organizations",))
def gov_mask_sensitive(b):
    o = dim_organizations(b).select("organization_id", "organization_name", "stripe_customer_id", "billing_email",
                                    "organization_status", "current_plan_name")
    return C.mask_sensitive(o)


def _cat_columns_sql():
    from ..sources.tables import SCHEMAS
    parts = []
    for t in TABLE_NAMES:
        for i, f in enumerate(SCHEMAS[t].fields):
            parts.append(f"SELECT '{t}' AS table_name, '{f.name}' AS column_name, {i + 1} AS ordinal_position, "
                         f"'{f.dataType.simpleString()}' AS data_type, '{C.sensitivity(f.name)}' AS sensitivity, "
                         f"count(*) AS row_count, count(*) - count({f.name}) AS null_count FROM {t}")
    return "\nUNION ALL\n".join(parts)


@register("cat_columns", _cat_columns_sql())
def cat_columns(b):
    return C.column_profile({t: b.t.scan(t) for t in TABLE_NAMES})
