"""Sinks: layer materialisation, atomic replace, JSONL audit append, CSV export.

All writes go to paths under the shared storage the caller passes in (on a
cluster: under ``spark.checkpoint.dir`` or a warehouse location), never to a
machine-local temporary folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .versions import VersionedTable

# Layer -> materialisation kind (views are lazy; tables are written).
LAYER_KIND = {"staging": "view", "core": "table", "gold": "view", "product": "table", "metrics": "table"}


def materialize(df: DataFrame, name: str, layer: str, path: str | None = None,
                partition_by: Sequence[str] = (), only: Sequence | None = None) -> DataFrame:
    """``snk_materialize``: a temp view for view layers, a versioned Parquet table
    for table layers; returns the DataFrame to use downstream (re-read from
    storage, lineage cut).

    A table partitioned by one column (e.g. by month, for partition pruning) is
    refreshed: partitions without changes keep their files, and ``only`` limits
    the work to the values that may have changed.
    """
    if LAYER_KIND.get(layer, "view") == "view" or path is None:
        df.createOrReplaceTempView(name)
        return df
    table = VersionedTable(df.sparkSession, path)
    if partition_by:
        (column,) = partition_by
        table.refresh(df, column, only)
    else:
        table.replace(df)
    out = table.read().select(*df.columns)
    out.createOrReplaceTempView(name)
    return out


def atomic_replace(df: DataFrame, path: str) -> str:
    """``src_atomic_replace``: the versioned table at ``path`` becomes ``df``.

    The new version is written in a folder of its own and becomes the table by
    the rename of its manifest; readers see the old version or the new one,
    whole, at every moment (``read_table``).
    """
    VersionedTable(df.sparkSession, path).replace(df)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version of the table at ``path``."""
    return VersionedTable(spark, path).read()


def append_jsonl(df: DataFrame, path: str) -> None:
    """``snk_append_jsonl``: append rows as JSON lines."""
    df.write.mode("append").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """``snk_result_export``: header CSV for spreadsheet use."""
    df.write.mode("overwrite").option("header", True).csv(path)
