"""Structured Streaming twins of the incremental and daily jobs.

Every job reads a file stream with a declared schema, keeps its progress in a
checkpoint under the shared ``spark.checkpoint.dir`` (so a restarted driver or
lost executors resume exactly where they stopped), and bounds its state with
an event-time watermark.  ``run_available_now`` drains what is available and
stops, which is how these jobs run as scheduled batch-like increments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import scratch_path
from ..sources import ingest
from ..sources.tables import SCHEMAS
from ..sources.versions import VersionedTable, watermark_of

LATE_DATA_BOUND = "1 day"        # how late an event may arrive and still count
SESSION_GAP = "12 hours"         # inactivity gap closing a session


def event_stream(spark: SparkSession, directory: str, pattern: str = "events*.parquet",
                 max_files_per_trigger: int = 64) -> DataFrame:
    """Raw event stream (file source, declared schema, no inference).

    Event-time operators need ``TIMESTAMP``; the stored wall-clock
    ``TIMESTAMP_NTZ`` is read as UTC (session time zone) and converted back to
    NTZ on output.
    """
    return (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", pattern).parquet(directory)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def _ntz(c):
    return F.col(c).cast("timestamp_ntz")


def incremental_ingest(stream: DataFrame, high_watermark: str | None, synced_at: str) -> DataFrame:
    """``str_incremental_ingest``: only rows above the stored watermark, stamped."""
    out = ingest.sync_stamp(ingest.watermark_filter(stream, "ts", high_watermark), synced_at)
    return out.withColumn("ts", _ntz("ts"))


def daily_kpis(stream: DataFrame) -> DataFrame:
    """``str_daily_kpis``: tumbling 1-day windows with a late-data bound, exact distinct users.

    Two chained aggregations: per day and user, then per day.  Both drop their
    state once the watermark passes a day, which is when the day is emitted.
    """
    errors = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    per_user = (stream.withWatermark("ts", LATE_DATA_BOUND).groupBy(F.window("ts", "1 day").alias("w"), "user_id")
                .agg(F.count(F.lit(1)).alias("n"), errors.alias("bad")))
    return (per_user.groupBy("w").agg(F.sum("n").alias("events"), F.sum("bad").alias("errors"), F.count("user_id").alias("users"))
            .select(F.to_date(F.col("w.start")).alias("event_date"), "events", "errors", "users"))


def trailing_active(stream: DataFrame) -> DataFrame:
    """``str_trailing_active``: sliding 7-day windows, 1-day slide, exact distinct users (see ``daily_kpis``)."""
    per_user = (stream.withWatermark("ts", LATE_DATA_BOUND).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "user_id")
                .agg(F.count(F.lit(1)).alias("n")))
    return (per_user.groupBy("w").agg(F.count("user_id").alias("active_users"))
            .select(F.to_date(F.col("w.start")).alias("window_start"), "active_users"))


def sessionize(stream: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """``str_sessionize``: gap-based sessions per user with ``session_window``; a session is
    emitted, and its state dropped, once the watermark passes its end."""
    return (stream.withWatermark("ts", gap)
            .groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_event_at"))
            .select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    _ntz("last_event_at").alias("last_event_at"), "event_count"))


def dedupe(stream: DataFrame) -> DataFrame:
    """``str_dedupe``: drop replayed event ids within the watermark horizon."""
    return stream.withWatermark("ts", LATE_DATA_BOUND).dropDuplicatesWithinWatermark(["event_id"])


def upsert_sink(target: str, keys: list[str], buckets: int = 64):
    """``str_upsert_batches``: a ``foreachBatch`` function merging each micro-batch
    latest-wins into a versioned table hashed into ``buckets`` by key.  An epoch
    rewrites only the buckets it touches; its number is committed with them, so
    a replayed epoch changes nothing."""

    def merge(batch: DataFrame, epoch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, target)
        if epoch_id > table.state().get("epoch", -1):
            table.upsert(batch, keys, buckets, state={"epoch": epoch_id})

    return merge


def ingest_sink(target: str, synced_at: str, stream: str, column: str = "ts"):
    """A ``foreachBatch`` function appending epochs to a versioned table.

    With an epoch's rows its number (by ``stream``, the checkpoint it counts in)
    and the highest ``column`` seen are committed: a replayed epoch adds nothing.
    """

    def append(batch: DataFrame, epoch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, target)
        epochs = table.state().get("epochs", {})
        if epoch_id > epochs.get(stream, -1):
            rows = ingest.sync_stamp(batch, synced_at).withColumn(column, _ntz(column))
            table.append(rows, state={"epochs": {**epochs, stream: epoch_id}}, measure=watermark_of(table, column, synced_at, "seen"))

    return append


def run_ingest(spark: SparkSession, directory: str, target: str, synced_at: str, checkpoint: str | None = None) -> int:
    """``str_incremental_ingest`` as a job: append what is new above the watermark of the last finished run.

    The watermark moves only when a run has finished, so files of a run that
    died are taken in full by the next one; epochs it had committed are not
    taken again as long as the checkpoint is kept.  Returns the rows of the table.
    """
    table = VersionedTable(spark, target)
    checkpoint = checkpoint or scratch_path(spark, "streams/ingest/checkpoint")
    rows = ingest.watermark_filter(event_stream(spark, directory), "ts", table.state().get("high_watermark"))
    q = start(rows, "ingest", foreach_batch=ingest_sink(target, synced_at, checkpoint), checkpoint=checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    state = table.state()
    if state.get("seen") != state.get("high_watermark"):
        table.annotate({"high_watermark": state["seen"]})
    return state.get("rows_total", 0)


def latest_table(spark: SparkSession, target: str) -> DataFrame:
    return VersionedTable(spark, target).read()


def start(df: DataFrame, name: str, mode: str = "append", sink: str = "parquet", path: str | None = None,
          foreach_batch=None, checkpoint: str | None = None) -> "DataStreamWriter":
    """Start a query with a checkpoint under the shared checkpoint dir and the
    available-now trigger (drain, then stop)."""
    spark = df.sparkSession
    ck = checkpoint or scratch_path(spark, f"streams/{name}/checkpoint")
    w = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    if foreach_batch is not None:
        return w.foreachBatch(foreach_batch).start()
    if sink == "memory":
        return w.format("memory").start()
    return w.format(sink).option("path", path).start()
