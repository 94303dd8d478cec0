"""Helpers shared by the training-data operators: stored intermediates,
byte-bounded Arrow batches and distributed connected components.

Conventions of every operator in this package: the caller names the id and
text columns, all other columns of the input are ignored (so clashing names
cannot matter), a null text counts as the empty text, repeated rows are
independent rows, and an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that removes an execution's shuffle files when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of these files, never a
    recomputation of what came before, and a frame used twice runs once.  The
    shuffles of the write are its own and go as soon as the files stand.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/meridian-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; nulls are empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str, budget: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``budget`` text bytes (one row at least).

    Only a slice's texts are held as Python objects at any time, so a batch of
    long documents costs no more memory than a batch of short ones.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > budget:
                yield (part := batch.slice(start, i - start)), as_bytes(part.column(text))
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield (part := batch.slice(start)), as_bytes(part.column(text))


def id_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The two columns an operator works on, under its own names."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with ``nth``, its rows' places from 0 in a total order, and the number of rows.

    A range-partitioned sort, stored; the driver sees one count per sort task.
    """
    ordered = stored(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    task, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    starts, before = [], 0
    for row in sorted(ordered.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((row["task"], before))
        before += row["n"]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "task long, first long"))
    return ordered.join(first, task == F.col("task")).select(*df.columns, (F.col("first") + nth).alias("nth")), before


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)``.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; ``component``
    is the smallest node of the component.  Alternating large-star and
    small-star steps: every step is a map-side-combined minimum per node and a
    join back, so a hub is reduced before the shuffle, and its join rows are
    split by AQE.  The graph between rounds is a stored table.
    """
    now, before = stored(_large_star(edges), "star"), None
    for _ in range(max_rounds):
        # Star graphs are the fixed point: what the two steps leave unchanged.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = stored(_large_star(_small_star(now)), "star")
    else:
        raise RuntimeError("components did not converge")
    members = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
