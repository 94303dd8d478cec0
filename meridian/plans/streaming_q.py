"""Batch twins of the streaming jobs (oracle-checkable), over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.shapes import latest_per_key
from ..sources import ingest
from .registry import register

EVENTS_HIGH_WATERMARK = "2024-01-15 00:00:00"
EVENTS_SYNCED_AT = "2024-01-31 00:00:00"
SESSION_GAP_SECONDS = 12 * 3600


@register("str_incremental_ingest", f"""SELECT *, TIMESTAMP '{EVENTS_SYNCED_AT}' AS _synced_at FROM events
WHERE ts > TIMESTAMP '{EVENTS_HIGH_WATERMARK}'""")
def str_incremental_ingest(b):
    return ingest.sync_stamp(ingest.watermark_filter(b.t.events, "ts", EVENTS_HIGH_WATERMARK), EVENTS_SYNCED_AT)


@register("str_upsert_batches", """
SELECT event_id, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'
UNION ALL SELECT event_id, user_id, event_type, value * 2 FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def str_upsert_batches(b):
    """Two deliveries: the first covers the whole month, the second re-delivers
    everything from the 10th with corrected values; the second wins per key."""
    e = b.t.events
    first = e.select("event_id", "user_id", "event_type", "value")
    second = e.filter(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) \
        .select("event_id", "user_id", "event_type", (F.col("value") * 2).alias("value"))
    return ingest.upsert_latest(first, second, ["event_id"])


@register("str_daily_kpis", """SELECT CAST(ts AS DATE) AS event_date, count(*) AS events,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(DISTINCT user_id) AS users
FROM events GROUP BY 1""")
def str_daily_kpis(b):
    e = b.t.events
    return e.groupBy(F.to_date("ts").alias("event_date")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"),
        F.countDistinct("user_id").alias("users"))


@register("str_trailing_active", """SELECT window_start, count(DISTINCT user_id) AS active_users FROM (
  SELECT user_id, CAST(unnest(generate_series(CAST(ts AS DATE) - INTERVAL 6 DAY, CAST(ts AS DATE), INTERVAL 1 DAY)) AS DATE)
         AS window_start FROM events) GROUP BY 1""")
def str_trailing_active(b):
    """Exact batch form of the sliding 7-day window: each (user, day) belongs to
    the 7 windows starting on that day and the 6 days before."""
    pairs = b.t.events.select("user_id", F.to_date("ts").alias("d")).distinct()
    ex = pairs.select("user_id", F.explode(F.sequence(F.date_sub("d", 6), F.col("d"))).alias("window_start"))
    return ex.groupBy("window_start").agg(F.countDistinct("user_id").alias("active_users"))


def sessionize_batch(events, user: str, ts: str, tie: str, gap_seconds: int):
    """Gap-based sessions without a per-user window over all of a user's events.

    Level 1 works inside (user, hour) buckets: an event opens a session when the
    gap to the previous event of the bucket reaches the session gap; the first
    event of a bucket is decided by the gap to the last event of the user's
    previous active bucket (one summary row per active hour).  A session's start
    is the latest opening event at or before each event -- within the bucket
    by a running max, across buckets by carrying the previous buckets' last
    opening forward over the per-bucket summaries (bounded by the calendar).
    """
    gap_us = gap_seconds * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # Buckets are hours: one hot user is split into hourly pieces and the
    # cross-bucket windows see at most one summary row per active hour.
    e = events.select(user, ts, tie).withColumn("_day", F.date_trunc("hour", F.col(ts).cast("timestamp")))
    w1 = Window.partitionBy(user, "_day").orderBy(ts, tie)
    e = e.withColumn("_prev", F.lag(ts).over(w1))
    days = e.groupBy(user, "_day").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    wd = Window.partitionBy(user).orderBy("_day")
    days = days.withColumn("_prev_day_last", F.lag("_last").over(wd))
    e = e.join(days.select(user, "_day", "_prev_day_last"), [user, "_day"])
    opens = F.when(F.col("_prev").isNotNull(), (us(ts) - us("_prev")) >= gap_us) \
        .otherwise(F.col("_prev_day_last").isNull() | ((us(ts) - us("_prev_day_last")) >= gap_us))
    e = e.withColumn("_open_ts", F.when(opens, F.col(ts)))
    running = Window.partitionBy(user, "_day").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("_start_in_day", F.max("_open_ts").over(running))
    last_open = e.groupBy(user, "_day").agg(F.max("_open_ts").alias("_day_last_open"))
    carry = Window.partitionBy(user).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    last_open = last_open.withColumn("_carried", F.max("_day_last_open").over(carry))
    e = e.join(last_open.select(user, "_day", "_carried"), [user, "_day"])
    start = F.coalesce("_start_in_day", "_carried")
    return e.groupBy(user, start.alias("session_start")).agg(F.max(ts).alias("last_event_at"),
                                                            F.count(F.lit(1)).alias("event_count"))


@register("str_sessionize", f"""SELECT user_id, min(ts) AS session_start, max(ts) AS last_event_at, count(*) AS event_count FROM (
  SELECT user_id, ts, sum(new_session) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no
  FROM (SELECT user_id, ts, event_id,
               CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                      OR date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts)
                         >= CAST({SESSION_GAP_SECONDS} AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS new_session FROM events))
GROUP BY user_id, session_no""")
def str_sessionize(b):
    """Gap-based sessions (batch twin of the session-window stream)."""
    return sessionize_batch(b.t.events, "user_id", "ts", "event_id", SESSION_GAP_SECONDS) \
        .select("user_id", "session_start", "last_event_at", "event_count")


@register("str_dedupe", """SELECT event_id, ts, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, user_id) AS rn FROM events) WHERE rn = 1""")
def str_dedupe(b):
    e = b.t.events.select("event_id", "ts", "user_id", "event_type")
    return latest_per_key(e, ["event_id"], [("ts", "asc"), ("user_id", "asc")])
