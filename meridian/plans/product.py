"""Product, engineering and operations marts (daily grain + 30-day KPI rollups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, exact_avg, exact_sum, rnd, safe_ratio
from ..operators.shapes import percentile_cont
from .core import dim_organizations, fct_sessions
from .oracle_views import AS_OF_SQL, view
from .registry import register

KPI_WINDOW_DAYS = 30


def _recent(df: DataFrame, b, col: str = "metric_date", days: int = KPI_WINDOW_DAYS) -> DataFrame:
    return df.filter(F.col(col) >= F.date_sub(F.lit(b.as_of).cast("date"), days))


# ---------------------------------------------------------------- eng_daily
def eng_daily(b) -> DataFrame:
    s = fct_sessions(b).select(F.col("session_date").alias("metric_date"), "session_status",
                               "error_count", "duration_seconds")
    daily = s.groupBy("metric_date").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        count_if(F.col("session_status") == "completed").alias("completed_sessions"),
        count_if(F.col("session_status") == "failed").alias("failed_sessions"),
        count_if(F.col("session_status") == "timeout").alias("timeout_sessions"),
        F.sum("error_count").alias("total_error_events"),
        F.avg("duration_seconds").alias("avg_duration_seconds"))
    pct = percentile_cont(s, ["metric_date"], "duration_seconds",
                          {"p95_duration_seconds": 0.95, "p99_duration_seconds": 0.99})
    d = daily.join(pct, "metric_date", "left")
    return d.select(
        "metric_date", "total_sessions", "completed_sessions", "failed_sessions", "timeout_sessions",
        "total_error_events",
        safe_ratio("completed_sessions", "total_sessions").alias("success_rate_pct"),
        safe_ratio("failed_sessions", "total_sessions").alias("failure_rate_pct"),
        safe_ratio("timeout_sessions", "total_sessions").alias("timeout_rate_pct"),
        safe_ratio("total_error_events", "total_sessions", 1000.0).alias("errors_per_1k_sessions"),
        rnd("avg_duration_seconds").alias("avg_duration_seconds"),
        "p95_duration_seconds", "p99_duration_seconds")


view("eng_daily", """
SELECT metric_date, total_sessions, completed_sessions, failed_sessions, timeout_sessions, total_error_events,
       round(completed_sessions::DOUBLE / nullif(total_sessions, 0) * 100, 2) AS success_rate_pct,
       round(failed_sessions::DOUBLE / nullif(total_sessions, 0) * 100, 2) AS failure_rate_pct,
       round(timeout_sessions::DOUBLE / nullif(total_sessions, 0) * 100, 2) AS timeout_rate_pct,
       round(total_error_events::DOUBLE / nullif(total_sessions, 0) * 1000, 2) AS errors_per_1k_sessions,
       round(avg_duration_seconds, 2) AS avg_duration_seconds,
       round(p95, 2) AS p95_duration_seconds, round(p99, 2) AS p99_duration_seconds
FROM (SELECT session_date AS metric_date, count(*) AS total_sessions,
             count(CASE WHEN session_status = 'completed' THEN 1 END) AS completed_sessions,
             count(CASE WHEN session_status = 'failed' THEN 1 END) AS failed_sessions,
             count(CASE WHEN session_status = 'timeout' THEN 1 END) AS timeout_sessions,
             CAST(sum(error_count) AS BIGINT) AS total_error_events,
             avg(duration_seconds) AS avg_duration_seconds,
             quantile_cont(duration_seconds::DOUBLE, 0.95) AS p95,
             quantile_cont(duration_seconds::DOUBLE, 0.99) AS p99
      FROM fct_sessions GROUP BY 1)
""", "fct_sessions")
register("eng_daily", "SELECT * FROM eng_daily", ("eng_daily",), inputs=("fct_sessions",))(eng_daily)


def eng_kpis(b) -> DataFrame:
    r = _recent(eng_daily(b), b)
    return r.agg(
        F.lit(b.as_of).cast("date").alias("as_of_date"),
        F.sum("total_sessions").alias("sessions_30d"),
        F.round(exact_avg("success_rate_pct", 2), 2).alias("avg_success_rate_pct_30d"),
        F.round(exact_avg("failure_rate_pct", 2), 2).alias("avg_failure_rate_pct_30d"),
        F.round(exact_avg("timeout_rate_pct", 2), 2).alias("avg_timeout_rate_pct_30d"),
        F.round(exact_avg("errors_per_1k_sessions", 2), 2).alias("avg_errors_per_1k_sessions_30d"),
        F.round(exact_avg("p95_duration_seconds", 2), 2).alias("avg_p95_duration_seconds_30d"),
        F.round(exact_avg("p99_duration_seconds", 2), 2).alias("avg_p99_duration_seconds_30d"))


view("eng_kpis", f"""
SELECT {AS_OF_SQL} AS as_of_date, CAST(sum(total_sessions) AS BIGINT) AS sessions_30d,
       round(sum(CAST(round(success_rate_pct * 100) AS BIGINT)) / 100.0 / nullif(count(success_rate_pct), 0), 2) AS avg_success_rate_pct_30d,
       round(sum(CAST(round(failure_rate_pct * 100) AS BIGINT)) / 100.0 / nullif(count(failure_rate_pct), 0), 2) AS avg_failure_rate_pct_30d,
       round(sum(CAST(round(timeout_rate_pct * 100) AS BIGINT)) / 100.0 / nullif(count(timeout_rate_pct), 0), 2) AS avg_timeout_rate_pct_30d,
       round(sum(CAST(round(errors_per_1k_sessions * 100) AS BIGINT)) / 100.0 / nullif(count(errors_per_1k_sessions), 0), 2) AS avg_errors_per_1k_sessions_30d,
       round(sum(CAST(round(p95_duration_seconds * 100) AS BIGINT)) / 100.0 / nullif(count(p95_duration_seconds), 0), 2) AS avg_p95_duration_seconds_30d,
       round(sum(CAST(round(p99_duration_seconds * 100) AS BIGINT)) / 100.0 / nullif(count(p99_duration_seconds), 0), 2) AS avg_p99_duration_seconds_30d
FROM eng_daily WHERE metric_date >= {AS_OF_SQL} - INTERVAL 30 DAY
""", "eng_daily")
register("eng_kpis", "SELECT * FROM eng_kpis", ("eng_kpis",), inputs=("eng_daily",))(eng_kpis)


# ------------------------------------------------------- pro_sessions_daily
def pro_sessions_daily(b) -> DataFrame:
    s = fct_sessions(b)
    keys = ["organization_id", "session_date"]
    agg = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        count_if(F.col("is_successful")).alias("successful_sessions"),
        count_if(F.col("session_status") == "failed").alias("failed_sessions"),
        count_if(F.col("session_status") == "timeout").alias("timeout_sessions"),
        F.sum("duration_seconds").alias("total_duration_seconds"),
        F.avg("duration_seconds").alias("avg_duration_seconds"),
        F.max("duration_seconds").alias("max_duration_seconds"),
        F.sum("pages_visited").alias("total_pages_visited"),
        F.sum("bytes_downloaded").alias("total_bytes_downloaded"),
        F.sum("bytes_uploaded").alias("total_bytes_uploaded"),
        F.sum("total_bytes_transferred").alias("total_bytes_transferred"),
        F.sum("event_count").alias("total_events"),
        F.sum("error_count").alias("total_errors"),
        count_if(F.col("used_proxy")).alias("sessions_with_proxy"),
        count_if(F.col("is_stealth_mode")).alias("sessions_with_stealth"),
        count_if(F.col("browser_type") == "chromium").alias("chromium_sessions"),
        count_if(F.col("browser_type") == "firefox").alias("firefox_sessions"),
        count_if(F.col("browser_type") == "webkit").alias("webkit_sessions"),
        F.countDistinct("initial_domain").alias("unique_domains_visited"))
    med = percentile_cont(s, keys, "duration_seconds", {"median_duration_seconds": 0.5})
    orgs = dim_organizations(b).select("organization_id", "current_plan_name")
    j = agg.join(med, keys, "left").join(orgs, "organization_id", "left")
    return j.select(
        "organization_id", "session_date", "current_plan_name", "total_sessions", "successful_sessions",
        "failed_sessions", "timeout_sessions",
        safe_ratio("successful_sessions", "total_sessions").alias("success_rate_pct"),
        "total_duration_seconds", rnd("avg_duration_seconds").alias("avg_duration_seconds"),
        "median_duration_seconds", "max_duration_seconds", "total_pages_visited", "total_bytes_downloaded",
        "total_bytes_uploaded", "total_bytes_transferred", "total_events", "total_errors",
        "sessions_with_proxy", "sessions_with_stealth", "chromium_sessions", "firefox_sessions",
        "webkit_sessions", "unique_domains_visited")


view("pro_sessions_daily", """
SELECT d.organization_id, d.session_date, o.current_plan_name, d.total_sessions, d.successful_sessions,
       d.failed_sessions, d.timeout_sessions,
       round(d.successful_sessions::DOUBLE / nullif(d.total_sessions, 0) * 100, 2) AS success_rate_pct,
       d.total_duration_seconds, round(d.avg_duration_seconds, 2) AS avg_duration_seconds,
       round(d.median_duration_seconds, 2) AS median_duration_seconds, d.max_duration_seconds,
       d.total_pages_visited, d.total_bytes_downloaded, d.total_bytes_uploaded, d.total_bytes_transferred,
       d.total_events, d.total_errors, d.sessions_with_proxy, d.sessions_with_stealth,
       d.chromium_sessions, d.firefox_sessions, d.webkit_sessions, d.unique_domains_visited
FROM (SELECT organization_id, session_date, count(*) AS total_sessions,
             count(CASE WHEN is_successful THEN 1 END) AS successful_sessions,
             count(CASE WHEN session_status = 'failed' THEN 1 END) AS failed_sessions,
             count(CASE WHEN session_status = 'timeout' THEN 1 END) AS timeout_sessions,
             CAST(sum(duration_seconds) AS BIGINT) AS total_duration_seconds,
             avg(duration_seconds) AS avg_duration_seconds,
             quantile_cont(duration_seconds::DOUBLE, 0.5) AS median_duration_seconds,
             max(duration_seconds) AS max_duration_seconds,
             CAST(sum(pages_visited) AS BIGINT) AS total_pages_visited,
             CAST(sum(bytes_downloaded) AS BIGINT) AS total_bytes_downloaded,
             CAST(sum(bytes_uploaded) AS BIGINT) AS total_bytes_uploaded,
             CAST(sum(total_bytes_transferred) AS BIGINT) AS total_bytes_transferred,
             CAST(sum(event_count) AS BIGINT) AS total_events, CAST(sum(error_count) AS BIGINT) AS total_errors,
             count(CASE WHEN used_proxy THEN 1 END) AS sessions_with_proxy,
             count(CASE WHEN is_stealth_mode THEN 1 END) AS sessions_with_stealth,
             count(CASE WHEN browser_type = 'chromium' THEN 1 END) AS chromium_sessions,
             count(CASE WHEN browser_type = 'firefox' THEN 1 END) AS firefox_sessions,
             count(CASE WHEN browser_type = 'webkit' THEN 1 END) AS webkit_sessions,
             count(DISTINCT initial_domain) AS unique_domains_visited
      FROM fct_sessions GROUP BY 1, 2) d
LEFT JOIN dim_organizations o ON d.organization_id = o.organization_id
""", "fct_sessions", "dim_organizations")
register("pro_sessions_daily", "SELECT * FROM pro_sessions_daily", ("pro_sessions_daily",),
         inputs=("fct_sessions", "dim_organizations"))(pro_sessions_daily)


# -------------------------------------------------------- pro_product_daily
def pro_product_daily(b) -> DataFrame:
    s = fct_sessions(b).withColumnRenamed("session_date", "metric_date")
    agg = s.groupBy("metric_date").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        count_if(F.col("is_successful")).alias("successful_sessions"),
        F.countDistinct("organization_id").alias("active_orgs"),
        F.avg("duration_seconds").alias("avg_duration_seconds"),
        F.avg("pages_visited").alias("avg_pages_visited"),
        count_if(F.col("used_proxy")).alias("sessions_with_proxy"),
        count_if(F.col("is_stealth_mode")).alias("sessions_with_stealth"),
        F.countDistinct("initial_domain").alias("unique_domains_visited"))
    med = percentile_cont(s, ["metric_date"], "duration_seconds", {"median_duration_seconds": 0.5})
    j = agg.join(med, "metric_date", "left")
    return j.select(
        "metric_date", "total_sessions", "successful_sessions",
        (F.col("total_sessions") - F.col("successful_sessions")).alias("failed_sessions"),
        safe_ratio("successful_sessions", "total_sessions").alias("success_rate_pct"),
        "active_orgs", rnd("avg_duration_seconds").alias("avg_duration_seconds"),
        "median_duration_seconds", rnd("avg_pages_visited").alias("avg_pages_visited"),
        "sessions_with_proxy", "sessions_with_stealth",
        safe_ratio("sessions_with_proxy", "total_sessions").alias("proxy_adoption_pct"),
        safe_ratio("sessions_with_stealth", "total_sessions").alias("stealth_adoption_pct"),
        "unique_domains_visited")


view("pro_product_daily", """
SELECT metric_date, total_sessions, successful_sessions, total_sessions - successful_sessions AS failed_sessions,
       round(successful_sessions::DOUBLE / nullif(total_sessions, 0) * 100, 2) AS success_rate_pct,
       active_orgs, round(avg_duration_seconds, 2) AS avg_duration_seconds,
       round(median_duration_seconds, 2) AS median_duration_seconds,
       round(avg_pages_visited, 2) AS avg_pages_visited, sessions_with_proxy, sessions_with_stealth,
       round(sessions_with_proxy::DOUBLE / nullif(total_sessions, 0) * 100, 2) AS proxy_adoption_pct,
       round(sessions_with_stealth::DOUBLE / nullif(total_sessions, 0) * 100, 2) AS stealth_adoption_pct,
       unique_domains_visited
FROM (SELECT session_date AS metric_date, count(*) AS total_sessions,
             count(CASE WHEN is_successful THEN 1 END) AS successful_sessions,
             count(DISTINCT organization_id) AS active_orgs, avg(duration_seconds) AS avg_duration_seconds,
             quantile_cont(duration_seconds::DOUBLE, 0.5) AS median_duration_seconds,
             avg(pages_visited) AS avg_pages_visited,
             count(CASE WHEN used_proxy THEN 1 END) AS sessions_with_proxy,
             count(CASE WHEN is_stealth_mode THEN 1 END) AS sessions_with_stealth,
             count(DISTINCT initial_domain) AS unique_domains_visited
      FROM fct_sessions GROUP BY 1)
""", "fct_sessions")
register("pro_product_daily", "SELECT * FROM pro_product_daily", ("pro_product_daily",),
         inputs=("fct_sessions",))(pro_product_daily)


def pro_product_kpis(b) -> DataFrame:
    r = _recent(pro_product_daily(b), b)
    return r.agg(
        F.lit(b.as_of).cast("date").alias("as_of_date"),
        F.sum("total_sessions").alias("sessions_30d"),
        F.round(exact_avg("success_rate_pct", 2), 2).alias("avg_success_rate_pct_30d"),
        F.round(exact_avg("avg_duration_seconds", 2), 2).alias("avg_duration_seconds_30d"),
        F.round(exact_avg("avg_pages_visited", 2), 2).alias("avg_pages_per_session_30d"),
        F.round(exact_avg("proxy_adoption_pct", 2), 2).alias("avg_proxy_adoption_pct_30d"),
        F.round(exact_avg("stealth_adoption_pct", 2), 2).alias("avg_stealth_adoption_pct_30d"),
        F.max("unique_domains_visited").alias("peak_unique_domains_visited_30d"))


view("pro_product_kpis", f"""
SELECT {AS_OF_SQL} AS as_of_date, CAST(sum(total_sessions) AS BIGINT) AS sessions_30d,
       round(sum(CAST(round(success_rate_pct * 100) AS BIGINT)) / 100.0 / nullif(count(success_rate_pct), 0), 2) AS avg_success_rate_pct_30d,
       round(sum(CAST(round(avg_duration_seconds * 100) AS BIGINT)) / 100.0 / nullif(count(avg_duration_seconds), 0), 2) AS avg_duration_seconds_30d,
       round(sum(CAST(round(avg_pages_visited * 100) AS BIGINT)) / 100.0 / nullif(count(avg_pages_visited), 0), 2) AS avg_pages_per_session_30d,
       round(sum(CAST(round(proxy_adoption_pct * 100) AS BIGINT)) / 100.0 / nullif(count(proxy_adoption_pct), 0), 2) AS avg_proxy_adoption_pct_30d,
       round(sum(CAST(round(stealth_adoption_pct * 100) AS BIGINT)) / 100.0 / nullif(count(stealth_adoption_pct), 0), 2) AS avg_stealth_adoption_pct_30d,
       max(unique_domains_visited) AS peak_unique_domains_visited_30d
FROM pro_product_daily WHERE metric_date >= {AS_OF_SQL} - INTERVAL 30 DAY
""", "pro_product_daily")
register("pro_product_kpis", "SELECT * FROM pro_product_kpis", ("pro_product_kpis",),
         inputs=("pro_product_daily",))(pro_product_kpis)


# ---------------------------------------------------------------- ops_daily
def ops_daily(b) -> DataFrame:
    s = fct_sessions(b)
    ds = s.groupBy(F.col("session_date").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.countDistinct("organization_id").alias("active_organizations"),
        F.sum("total_bytes_transferred").alias("total_bytes_transferred"),
        F.sum("duration_seconds").alias("total_duration_seconds"),
        F.avg("duration_seconds").alias("avg_duration_seconds"),
        count_if(F.col("used_proxy")).alias("proxy_sessions"),
        count_if(F.col("is_stealth_mode")).alias("stealth_sessions"))
    oc = (b.organizations.groupBy(F.to_date("created_at").alias("metric_date"))
          .agg(F.count(F.lit(1)).alias("orgs_created")))
    ak = (b.api_keys.groupBy(F.to_date("created_at").alias("metric_date"))
          .agg(F.count(F.lit(1)).alias("api_keys_created"),
               count_if(F.col("status") == "active").alias("active_api_keys_created")))
    j = ds.join(oc, "metric_date", "left").join(ak, "metric_date", "left")
    return j.select(
        "metric_date", "total_sessions", "active_organizations",
        F.round(F.col("total_bytes_transferred") / 1024.0 / 1024.0 / 1024.0, 3).alias("total_gb_transferred"),
        F.round(F.col("total_duration_seconds") / 3600.0, 2).alias("total_session_hours"),
        rnd("avg_duration_seconds").alias("avg_duration_seconds"),
        "proxy_sessions", "stealth_sessions",
        safe_ratio("proxy_sessions", "total_sessions").alias("proxy_session_pct"),
        safe_ratio("stealth_sessions", "total_sessions").alias("stealth_session_pct"),
        F.coalesce("orgs_created", F.lit(0)).alias("orgs_created"),
        F.coalesce("api_keys_created", F.lit(0)).alias("api_keys_created"),
        F.coalesce("active_api_keys_created", F.lit(0)).alias("active_api_keys_created"))


view("ops_daily", """
SELECT ds.metric_date, ds.total_sessions, ds.active_organizations,
       round(ds.total_bytes_transferred / 1024.0 / 1024.0 / 1024.0, 3) AS total_gb_transferred,
       round(ds.total_duration_seconds / 3600.0, 2) AS total_session_hours,
       round(ds.avg_duration_seconds, 2) AS avg_duration_seconds, ds.proxy_sessions, ds.stealth_sessions,
       round(ds.proxy_sessions::DOUBLE / nullif(ds.total_sessions, 0) * 100, 2) AS proxy_session_pct,
       round(ds.stealth_sessions::DOUBLE / nullif(ds.total_sessions, 0) * 100, 2) AS stealth_session_pct,
       coalesce(oc.orgs_created, 0) AS orgs_created, coalesce(ak.api_keys_created, 0) AS api_keys_created,
       coalesce(ak.active_api_keys_created, 0) AS active_api_keys_created
FROM (SELECT session_date AS metric_date, count(*) AS total_sessions,
             count(DISTINCT organization_id) AS active_organizations,
             CAST(sum(total_bytes_transferred) AS BIGINT) AS total_bytes_transferred,
             CAST(sum(duration_seconds) AS BIGINT) AS total_duration_seconds,
             avg(duration_seconds) AS avg_duration_seconds,
             count(CASE WHEN used_proxy THEN 1 END) AS proxy_sessions,
             count(CASE WHEN is_stealth_mode THEN 1 END) AS stealth_sessions
      FROM fct_sessions GROUP BY 1) ds
LEFT JOIN (SELECT CAST(created_at AS DATE) AS metric_date, count(*) AS orgs_created
           FROM b_organizations GROUP BY 1) oc ON ds.metric_date = oc.metric_date
LEFT JOIN (SELECT CAST(created_at AS DATE) AS metric_date, count(*) AS api_keys_created,
                  count(CASE WHEN status = 'active' THEN 1 END) AS active_api_keys_created
           FROM b_api_keys GROUP BY 1) ak ON ds.metric_date = ak.metric_date
""", "fct_sessions", "b_organizations", "b_api_keys")
register("ops_daily", "SELECT * FROM ops_daily", ("ops_daily",),
         inputs=("fct_sessions", "dim_organizations"))(ops_daily)


def ops_kpis(b) -> DataFrame:
    r = _recent(ops_daily(b), b)
    return r.agg(
        F.lit(b.as_of).cast("date").alias("as_of_date"),
        F.sum("total_sessions").alias("sessions_30d"),
        F.round(exact_sum("total_gb_transferred", 3), 3).alias("total_gb_transferred_30d"),
        F.round(exact_sum("total_session_hours", 2), 2).alias("total_session_hours_30d"),
        F.round(exact_avg("avg_duration_seconds", 2), 2).alias("avg_duration_seconds_30d"),
        F.round(exact_avg("proxy_session_pct", 2), 2).alias("avg_proxy_session_pct_30d"),
        F.round(exact_avg("stealth_session_pct", 2), 2).alias("avg_stealth_session_pct_30d"),
        F.sum("api_keys_created").alias("api_keys_created_30d"),
        F.sum("active_api_keys_created").alias("active_api_keys_created_30d"))


view("ops_kpis", f"""
SELECT {AS_OF_SQL} AS as_of_date, CAST(sum(total_sessions) AS BIGINT) AS sessions_30d,
       round(sum(CAST(round(total_gb_transferred * 1000) AS BIGINT)) / 1000.0, 3) AS total_gb_transferred_30d,
       round(sum(CAST(round(total_session_hours * 100) AS BIGINT)) / 100.0, 2) AS total_session_hours_30d,
       round(sum(CAST(round(avg_duration_seconds * 100) AS BIGINT)) / 100.0 / nullif(count(avg_duration_seconds), 0), 2) AS avg_duration_seconds_30d,
       round(sum(CAST(round(proxy_session_pct * 100) AS BIGINT)) / 100.0 / nullif(count(proxy_session_pct), 0), 2) AS avg_proxy_session_pct_30d,
       round(sum(CAST(round(stealth_session_pct * 100) AS BIGINT)) / 100.0 / nullif(count(stealth_session_pct), 0), 2) AS avg_stealth_session_pct_30d,
       CAST(sum(api_keys_created) AS BIGINT) AS api_keys_created_30d,
       CAST(sum(active_api_keys_created) AS BIGINT) AS active_api_keys_created_30d
FROM ops_daily WHERE metric_date >= {AS_OF_SQL} - INTERVAL 30 DAY
""", "ops_daily")
register("ops_kpis", "SELECT * FROM ops_kpis", ("ops_kpis",), inputs=("ops_daily",))(ops_kpis)
