"""Structured Streaming jobs agree with their batch twins."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from meridian.plans import streaming_q
from meridian.sources.bindings import Bindings
from meridian.streaming import jobs

SF = "/root/testdata/sf0.001"
EVENTS = SF  # directory; the stream picks events*.parquet


def _drain(q):
    q.awaitTermination(300)
    assert q.exception() is None


def _ck(name):
    return os.path.join(tempfile.mkdtemp(prefix="meridian-stream-"), name)


def _with_flush(spark):
    """The events, and in a later file one event of the far future that lets every window close."""
    d = tempfile.mkdtemp(prefix="meridian-events-")
    shutil.copy(f"{SF}/events.parquet", f"{d}/events-0.parquet")
    e = spark.read.parquet(f"{SF}/events.parquet")
    late = e.limit(1).select("event_id", (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), "user_id", "event_type", "value", "props")
    late.toPandas().to_parquet(f"{d}/events-1.parquet", coerce_timestamps="us")
    os.utime(f"{d}/events-0.parquet", (1, 1))
    return jobs.event_stream(spark, d, max_files_per_trigger=1)


def _appended(spark, job, name):
    q = jobs.start(job(_with_flush(spark)), name, mode="append", sink="memory", checkpoint=_ck(name))
    _drain(q)
    rows = q.lastProgress["stateOperators"] if q.lastProgress else []
    # Only what the flushing event opened may still be held.
    assert all(r["numRowsTotal"] <= 7 for r in rows)
    return spark.table(name)


def test_stream_sessionize_matches_batch(spark):
    got = {(r.user_id, r.session_start, r.event_count) for r in _appended(spark, jobs.sessionize, "t_sessions").collect()}
    want = {(r.user_id, r.session_start, r.event_count)
            for r in streaming_q.str_sessionize(Bindings(spark, SF)).collect()}
    assert got == want and len(got) > 0


def test_stream_daily_kpis_matches_batch(spark):
    got = {tuple(r) for r in _appended(spark, jobs.daily_kpis, "t_daily").collect()}
    want = streaming_q.str_daily_kpis(Bindings(spark, SF)).select("event_date", "events", "errors", "users")
    assert got == {tuple(r) for r in want.collect()}


def test_stream_trailing_active_matches_batch(spark):
    got = {r.window_start: r.active_users for r in _appended(spark, jobs.trailing_active, "t_trailing").collect()}
    assert got == {r.window_start: r.active_users for r in streaming_q.str_trailing_active(Bindings(spark, SF)).collect()}


def test_stream_dedupe_and_ingest(spark):
    out = _ck("ingest_out")
    s = jobs.incremental_ingest(jobs.dedupe(jobs.event_stream(spark, EVENTS)), streaming_q.EVENTS_HIGH_WATERMARK,
                                streaming_q.EVENTS_SYNCED_AT)
    _drain(jobs.start(s, "t_ingest", mode="append", sink="parquet", path=out, checkpoint=_ck("i")))
    got = spark.read.parquet(out)
    want = streaming_q.str_incremental_ingest(Bindings(spark, SF))
    assert got.count() == want.count()
    assert got.select("event_id").exceptAll(want.select("event_id")).count() == 0
    # Restart from the same checkpoint: nothing new to process, output unchanged.
    _drain(jobs.start(s, "t_ingest2", mode="append", sink="parquet", path=out, checkpoint=_ck("i")))


def test_upsert_batches_latest_wins(spark):
    b = Bindings(spark, SF)
    e = b.t.events
    first = e.select("event_id", "user_id", "event_type", "value")
    second = e.filter(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) \
        .select("event_id", "user_id", "event_type", (F.col("value") * 2).alias("value"))
    target = _ck("upsert_target")
    merge = jobs.upsert_sink(target, ["event_id"])
    merge(first, 0)
    merge(second, 1)
    merge(second, 1)  # a replayed epoch is idempotent
    got = jobs.latest_table(spark, target)
    want = streaming_q.str_upsert_batches(b)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_stream_restart_resumes_from_default_checkpoint(spark):
    import uuid

    name = f"t_restart_{uuid.uuid4().hex[:8]}"
    out = _ck("restart_out")
    s = jobs.incremental_ingest(jobs.event_stream(spark, EVENTS), None, streaming_q.EVENTS_SYNCED_AT)
    _drain(jobs.start(s, name, mode="append", sink="parquet", path=out))
    first = spark.read.parquet(out).count()
    _drain(jobs.start(s, name, mode="append", sink="parquet", path=out))  # same name -> same checkpoint
    assert spark.read.parquet(out).count() == first == spark.read.parquet(f"{SF}/events.parquet").count()
