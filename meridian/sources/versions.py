"""Versioned tables: Parquet folders and a manifest that says which of them are the table.

    <path>/data/__v=<n>-<id>/...         files of one write; never changed afterwards
    <path>/_manifests/<n>.json           the table as of version n: its parts and its state

A version exists once its manifest has been renamed into place, which is one
atomic step of the file system; everything before that leaves readers with the
version before, everything after it with the new one.  A reader resolves the
newest manifest and then reads files that no later write touches.  Because a
manifest lists parts, a write may replace all of them (``replace``), those of
some partition values (``refresh``), those of some hash buckets (``upsert``) or
add one (``append``); state such as a watermark or the last epoch is committed
with the data it describes.  Two writers of one version cannot both succeed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import sync_stamp, upsert_latest

#: The column of the data folders' names, and that of hash buckets.
VERSION, BUCKET = "__v", "__bucket"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class VersionConflict(RuntimeError):
    """Another writer has committed the version this one was to become."""


class VersionedTable:
    """A table at ``path``; every method that writes commits one version and returns its number.

    The newest ``keep`` versions stay readable; files that only older ones name
    are removed after a commit.  A failed write leaves files that no manifest
    names; ``expire`` removes those of versions that have been passed.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._fs_of = spark._jvm.org.apache.hadoop.fs
        self._root = self._fs_of.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # -- reading ---------------------------------------------------------------

    def versions(self) -> list[int]:
        names = [s for s in self._names("_manifests") if s.endswith(".json") and s[0] not in "._"]
        return sorted(int(s.split(".")[0]) for s in names)

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version (default: the newest), or None for a table never written."""
        known = self.versions()
        if not known:
            return None
        file = self._at(f"_manifests/{known[-1] if version is None else version:010d}.json")
        stream = self._fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def state(self) -> dict:
        return (self.manifest() or {}).get("state", {})

    def read(self, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """The table as of a version, or some of its parts; later writes do not change it."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"{self.path} has no committed version")
        rows = self._files(found, found["parts"] if parts is None else [p for p in parts if p in found["parts"]])
        return rows.drop(BUCKET) if "buckets" in found else rows

    def _files(self, manifest: dict, parts: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = sorted({f"{self.path}/data/{manifest['parts'][p]['folder']}" for p in parts})
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema.add(VERSION, "string", True) if VERSION not in schema.names else schema)
        return reader.option("basePath", f"{self.path}/data").parquet(*folders).select(*[f.name for f in schema.fields if f.name != VERSION])

    # -- writing ---------------------------------------------------------------

    def replace(self, df: DataFrame, state: dict | None = None) -> int:
        """The table becomes ``df``."""
        base = self.manifest()
        folder = self._write(df, base)
        return self._commit(base, df.schema, {"all": {"folder": folder}}, state)

    def append(self, df: DataFrame, state: dict | None = None, measure: Callable[[DataFrame], dict | None] | None = None) -> int:
        """The table gains the rows of ``df``.

        ``measure`` sees the rows as written and returns state to commit with
        them, or None to commit nothing.
        """
        base = self.manifest()
        folder = self._write(df, base)
        part = {folder: {"folder": folder}}
        more = measure(self._files({"schema": df.schema.jsonValue(), "parts": part}, part)) if measure else {}
        if more is None:
            return base["version"] if base else 0
        return self._commit(base, df.schema, {**(base["parts"] if base else {}), **part}, {**(state or {}), **more})

    def annotate(self, state: dict) -> int:
        """The same rows with more state."""
        base = self.manifest()
        return self._commit(base, T.StructType.fromJson(base["schema"]), base["parts"], state)

    def refresh(self, df: DataFrame, column: str, only: Sequence | None = None) -> int:
        """Partition by ``column``; parts whose rows are unchanged keep their files.

        ``only`` names the values that may have changed: nothing else is
        computed or written.  Without it the whole of ``df`` is written once,
        and a part is replaced where its row count or the sum of its rows'
        hashes differs.  A value that is gone loses its part.  Large values are split
        into several files by size, small ones share tasks (a rebalancing
        exchange), so no value decides a task's size.
        """
        base = self.manifest()
        rows = df if only is None else df.where(F.col(column).isin([v for v in only if v is not None]) | (F.col(column).isNull() if None in only else F.lit(False)))
        folder = self._write(rows.hint("rebalance", F.col(column)), base, column)
        schema = T.StructType([f for f in df.schema.fields if f.name != column] + [df.schema[column]])
        written = {unquote(n.split("=", 1)[1]): {"folder": f"{folder}/{n}"} for n in self._names(f"data/{folder}") if n.startswith(f"{column}=")}
        probe = {"schema": schema.jsonValue(), "parts": written}
        others = [F.col(c) for c in schema.names if c != column]
        marks = self._files(probe, written).groupBy(F.coalesce(F.col(column).cast("string"), F.lit(NULL_PARTITION)).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*others).cast("decimal(38,0)")).cast("string").alias("h"))
        for r in marks.collect():  # one row per part, like the manifest
            written[r["p"]]["mark"] = f"{r['n']}:{r['h']}"
        before = base["parts"] if base and base["schema"] == schema.jsonValue() else {}
        parts = {p: before[p] if p in before and before[p].get("mark") == w["mark"] else w for p, w in written.items()}
        if only is not None:
            named = {NULL_PARTITION if v is None else str(v) for v in only}
            parts |= {p: w for p, w in before.items() if p not in named}
        for p, w in written.items():
            if parts[p] is not w:
                self._fs.delete(self._at(f"data/{w['folder']}"), True)
        return self._commit(base, schema, parts, None)

    def upsert(self, delta: DataFrame, keys: Sequence[str], buckets: int = 64, state: dict | None = None, order: Sequence[tuple[str, str]] = ()) -> int:
        """Merge ``delta`` by key, the incoming row wins; only hash buckets it touches are rewritten.

        A table is bucketed by its first upsert; the number of buckets and the
        keys stay those of that one.
        """
        base = self.manifest()
        if base:
            buckets, was = base["buckets"]["n"], base["buckets"]["keys"]
            if was != list(keys):
                raise ValueError(f"{self.path} is bucketed by {was}")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [str(r["b"]) for r in delta.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return self._commit(base, delta.schema, base["parts"] if base else {}, state, {"n": buckets, "keys": list(keys)})
        old = self._files(base, [p for p in touched if p in base["parts"]]).drop(BUCKET) if base else delta.limit(0)
        merged = upsert_latest(old, delta, keys, order).withColumn(BUCKET, bucket)
        folder = self._write(merged.repartition(F.col(BUCKET)), base, BUCKET)
        written = {p: {"folder": f"{folder}/{BUCKET}={p}"} for p in touched}
        return self._commit(base, merged.schema, {**(base["parts"] if base else {}), **written}, state, {"n": buckets, "keys": list(keys)})

    def expire(self) -> None:
        """Remove versions before the newest ``keep``, and data that no remaining one names."""
        known = self.versions()
        kept, passed = known[-self.keep:], known[:-self.keep]
        manifests = [self.manifest(v) for v in kept]
        for v in passed:
            self._fs.delete(self._at(f"_manifests/{v:010d}.json"), False)
        named = {w["folder"] for m in manifests for w in m["parts"].values()}
        writes = {f.split("/")[0] for f in named}
        for name in self._names("data"):
            if int(name.split("=")[1].split("-")[0]) > known[-1]:
                continue  # a write under way
            if name not in writes:
                self._fs.delete(self._at(f"data/{name}"), True)
            elif name not in named:
                for part in self._names(f"data/{name}"):
                    if "=" in part and f"{name}/{part}" not in named:
                        self._fs.delete(self._at(f"data/{name}/{part}"), True)

    def _write(self, df: DataFrame, base: dict | None, by: str | None = None) -> str:
        folder = f"{VERSION}={(base['version'] if base else 0) + 1:010d}-{uuid.uuid4().hex[:12]}"
        writer = df.write
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/data/{folder}")
        return folder

    def _commit(self, base: dict | None, schema: T.StructType, parts: dict, state: dict | None, buckets: dict | None = None) -> int:
        version = (base["version"] if base else 0) + 1
        body = {"version": version, "schema": schema.jsonValue(), "parts": parts, "state": {**(base or {}).get("state", {}), **(state or {})}}
        if buckets or (base and "buckets" in base):
            body["buckets"] = buckets or base["buckets"]
        self._publish(version, json.dumps(body).encode())
        self.expire()
        return version

    def _publish(self, version: int, body: bytes) -> None:
        """Write the manifest under a name nobody reads, then rename it."""
        draft, final = self._at(f"_manifests/.{uuid.uuid4().hex}"), self._at(f"_manifests/{version:010d}.json")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise VersionConflict(f"{self.path} already has version {version}")

    def _at(self, name: str):
        return self._fs_of.Path(f"{self.path}/{name}")

    def _names(self, name: str) -> list[str]:
        folder = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []


def ingest_above_watermark(table: VersionedTable, source: DataFrame, column: str, key: Sequence[str], synced_at: str) -> int:
    """``str_incremental_ingest``: append the rows that earlier runs have not taken; returns how many.

    The high watermark is part of the table's state and committed with the rows
    it covers, so a run that dies has taken nothing and a repeated one takes
    nothing twice.  Rows at the watermark itself are told from those already
    taken by ``key``; rows below it are late and stay out.
    """
    high = table.state().get("high_watermark")
    rows = source
    if high is not None:
        at = F.lit(high).cast(source.schema[column].dataType)
        taken = table.read().where(F.col(column) == at).select(*key)
        rows = source.where(F.col(column) > at).unionByName(source.where(F.col(column) == at).join(taken, list(key), "left_anti").select(*source.columns))
    before = table.state().get("rows_total", 0)
    table.append(sync_stamp(rows, synced_at), measure=watermark_of(table, column, synced_at))
    return table.state().get("rows_total", 0) - before


def watermark_of(table: VersionedTable, column: str, synced_at: str, name: str = "high_watermark") -> Callable[[DataFrame], dict | None]:
    """State after an append: the highest ``column`` so far, rows of this run and of all; nothing for no rows."""
    state = table.state()

    def measure(written: DataFrame) -> dict | None:
        got = written.agg(F.max(column).cast("string").alias("high"), F.count(F.lit(1)).alias("n")).first()
        if not got["n"] and state:
            return None
        high = max(filter(None, (state.get(name), got["high"])), default=None)  # ISO texts order like the times
        return {name: high, "rows_synced": got["n"], "rows_total": state.get("rows_total", 0) + got["n"], "last_synced_at": synced_at}

    return measure
