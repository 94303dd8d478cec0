"""Versioned tables: whole tables for readers at every step, touched buckets and
partitions only, watermarks without loss or repeats."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from meridian.sources import sinks
from meridian.sources.versions import VersionConflict, VersionedTable, ingest_above_watermark
from meridian.streaming import jobs

SF = "/root/testdata/sf0.001"


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="meridian-versions-"), "table")


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def _ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("step", ["_write", "_publish", "expire", "draft"])
def test_a_crash_at_any_step_leaves_a_whole_table(spark, monkeypatch, step):
    path = _path()
    table = VersionedTable(spark, path)
    table.replace(spark.range(100))
    reader = table.read()  # in the middle of the replace
    crashing = VersionedTable(spark, path)
    if step == "draft":  # dies after the manifest's draft, before its rename
        def rename(*_):
            raise OSError("gone")
        monkeypatch.setattr(crashing, "_fs", type("Fs", (), {"create": crashing._fs.create, "exists": crashing._fs.exists, "open": crashing._fs.open,
                                                             "listStatus": crashing._fs.listStatus, "rename": staticmethod(rename), "delete": crashing._fs.delete})())
    else:
        def die(*_):
            raise OSError("gone")
        monkeypatch.setattr(crashing, step, die)
    with pytest.raises(OSError, match="gone"):
        crashing.replace(spark.range(200))
    assert _ids(table.read()) == list(range(200 if step == "expire" else 100))
    assert _ids(reader) == list(range(100))
    for n in (300, 400, 500):  # later writes succeed and clear away what the crash left
        VersionedTable(spark, path).replace(spark.range(n))
    assert table.read().count() == 500
    assert len(_files(path)) <= 2 * spark.range(1).sparkSession.sparkContext.defaultParallelism


def test_readers_of_the_version_before_are_not_disturbed(spark):
    path = _path()
    for n in range(1, 5):
        sinks.atomic_replace(spark.range(n), path)
        if n > 1:
            assert old.count() == n - 1
        old = sinks.read_table(spark, path)
    assert VersionedTable(spark, path).versions() == [3, 4]


def test_two_writers_of_one_version_cannot_both_win(spark, monkeypatch):
    path = _path()
    a, b = VersionedTable(spark, path), VersionedTable(spark, path)
    a.replace(spark.range(1))
    stale = b.manifest()
    a.replace(spark.range(2))
    monkeypatch.setattr(b, "manifest", lambda version=None: stale)
    with pytest.raises(VersionConflict):
        b.replace(spark.range(3))
    assert a.read().count() == 2


def test_upsert_rewrites_only_the_buckets_it_touches(spark):
    path, merge = _path(), None
    merge = jobs.upsert_sink(path, ["k"], buckets=16)
    merge(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")), 0)
    before = _files(path)
    delta = spark.createDataFrame([(3, "new"), (3, "new"), (2000, "new"), (None, "null key")], "k long, v string")
    merge(delta, 1)
    touched = delta.select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("b")).distinct().count()
    rewritten = {os.path.basename(os.path.dirname(f)) for f in _files(path) - before}
    assert len(rewritten) == touched < 16
    want = {**{i: "old" for i in range(1000)}, 3: "new", 2000: "new", None: "null key"}
    assert {r.k: r.v for r in jobs.latest_table(spark, path).collect()} == want
    again = _files(path)
    merge(delta, 1)  # replayed
    merge(spark.createDataFrame([(5, "lost")], "k long, v string"), 0)
    assert _files(path) == again
    jobs.upsert_sink(path, ["k"])(spark.createDataFrame([(5, "later")], "k long, v string"), 2)  # a restarted job keeps the buckets
    assert {r.k: r.v for r in jobs.latest_table(spark, path).collect()} == {**want, 5: "later"}
    jobs.upsert_sink(path, ["k"])(delta.limit(0), 3)
    assert VersionedTable(spark, path).state()["epoch"] == 3 and jobs.latest_table(spark, path).count() == len(want)


def test_a_crashed_upsert_epoch_is_taken_again(spark, monkeypatch):
    path = _path()
    rows = lambda v: spark.range(50).select("id", F.lit(v).alias("v"))
    jobs.upsert_sink(path, ["id"], 4)(rows("a"), 0)
    monkeypatch.setattr(VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        jobs.upsert_sink(path, ["id"], 4)(rows("b"), 1)
    monkeypatch.undo()
    assert {r.v for r in jobs.latest_table(spark, path).collect()} == {"a"}
    jobs.upsert_sink(path, ["id"], 4)(rows("b"), 1)
    assert {r.v for r in jobs.latest_table(spark, path).collect()} == {"b"}


def test_a_refresh_leaves_other_partitions_alone(spark):
    path, rnd = _path(), random.Random(2)
    rows = [(i, f"m{rnd.randint(1, 6)}" if i % 9 else None, "a b/c=%" if i % 2 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, month string, v string")
    out = sinks.materialize(df, "facts", "core", path, partition_by=["month"])
    assert out.columns == df.columns and out.exceptAll(df).count() == 0 and df.exceptAll(out).count() == 0
    before = _files(path)
    changed = df.withColumn("v", F.when((F.col("month") == "m3") & (F.col("id") < 100), F.lit("new")).otherwise(F.col("v")))
    out = sinks.materialize(changed, "facts", "core", path, partition_by=["month"])
    assert out.exceptAll(changed).count() == 0 and out.count() == 500
    assert {os.path.basename(os.path.dirname(f)) for f in _files(path) - before} == {"month=m3"}
    before = _files(path)
    last = changed.where("month is null or month not in ('m4')").withColumn("id", F.when(F.col("month") == "m5", -F.col("id")).otherwise(F.col("id")))
    out = sinks.materialize(last.where("month <> 'm1'"), "facts", "core", path, partition_by=["month"], only=["m4", "m5"])
    assert {os.path.basename(os.path.dirname(f)) for f in _files(path) - before} == {"month=m5"}
    assert sorted(map(repr, out.collect())) == sorted(map(repr, last.collect()))  # m1 was not asked for and stays
    assert out.where("month = 'm5'")._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(month")


def test_a_hot_partition_is_written_by_several_tasks(spark):
    path = _path()
    wide = spark.range(0, 300_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("m"), F.col("id") % 40)).alias("month"),
                                                F.sha2(F.col("id").cast("string"), 512).alias("body"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        VersionedTable(spark, path).refresh(wide, "month")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes") if size is None else spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    sizes = [os.path.getsize(f) for f in _files(path)]
    hot = [f for f in _files(path) if "month=hot" in f]
    assert len(hot) >= 4 and max(sizes) < sum(sizes) / 8
    assert VersionedTable(spark, path).read().count() == 300_000


def test_watermark_runs_lose_and_repeat_nothing(spark, monkeypatch):
    path = _path()
    table = VersionedTable(spark, path)
    source = lambda n: spark.range(n).select("id", F.timestamp_seconds(F.col("id") / 10).cast("timestamp_ntz").cast("date").cast("timestamp_ntz").alias("day"),
                                             F.timestamp_seconds((F.col("id") / 10).cast("long")).cast("timestamp_ntz").alias("ts"))
    assert ingest_above_watermark(table, source(105), "ts", ["id"], "2024-01-01 00:00:00") == 105
    assert ingest_above_watermark(table, source(105), "ts", ["id"], "2024-01-02 00:00:00") == 0
    monkeypatch.setattr(VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        ingest_above_watermark(table, source(200), "ts", ["id"], "2024-01-03 00:00:00")
    monkeypatch.undo()
    assert _ids(table.read().select("id")) == list(range(105))
    # Five more rows share the time of the last one taken.
    assert ingest_above_watermark(table, source(200), "ts", ["id"], "2024-01-03 00:00:00") == 95
    assert _ids(table.read().select("id")) == list(range(200))
    assert table.state()["rows_total"] == 200 and table.state()["high_watermark"].startswith("1970-01-01 00:00:19")


def test_stream_ingest_resumes_from_committed_state(spark, monkeypatch):
    folder, path, ck = tempfile.mkdtemp(prefix="meridian-in-"), _path(), _path()
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").toPandas()
    half = len(events) // 2
    save = lambda part, name: part.to_parquet(f"{folder}/{name}", coerce_timestamps="us")
    save(events[:half], "events-0.parquet")
    publish, calls = VersionedTable._publish, []

    def dies_once(self, *a):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("gone")
        return publish(self, *a)

    monkeypatch.setattr(VersionedTable, "_publish", dies_once)
    with pytest.raises(Exception, match="gone"):
        jobs.run_ingest(spark, folder, path, "2024-02-01 00:00:00", ck)
    assert jobs.run_ingest(spark, folder, path, "2024-02-01 00:00:00", ck) == half
    assert jobs.run_ingest(spark, folder, path, "2024-02-01 00:00:00", ck) == half
    save(events[half:], "events-1.parquet")
    total = jobs.run_ingest(spark, folder, path, "2024-02-02 00:00:00", ck)
    high = events["ts"][:half].max()
    want = half + int((events["ts"][half:] > high).sum())
    assert total == want == VersionedTable(spark, path).read().select("event_id").count()
    # A new checkpoint starts from the table's watermark, not from the beginning.
    assert jobs.run_ingest(spark, folder, path, "2024-02-03 00:00:00", _path()) == want
