"""Ingestion operators: typed extract, column alignment, JSON encoding, load
stamps, incremental watermarks, latest-wins upserts, optional tables/columns,
typed CSV seeds, row counts and previews.

Everything is a DataFrame transformation; the incremental state is itself a
DataFrame (one row per table) so it can be persisted with any sink.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shapes import latest_per_key


def col_or_null(df: DataFrame, name: str, dtype: T.DataType | str) -> Column:
    """``src_optional_column``: the column if present, else a typed NULL."""
    if name in df.columns:
        return F.col(name).cast(dtype).alias(name)
    return F.lit(None).cast(dtype).alias(name)


def align_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``src_align_columns``: keep destination columns present in the source
    (cast to the declared type), NULL-fill the missing ones, drop the rest."""
    return df.select(*[col_or_null(df, f.name, f.dataType) for f in schema.fields])


def json_encode_nested(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """``src_json_encode_nested``: struct/map/array columns become JSON text,
    except the columns named in ``keep``."""
    keep = set(keep)
    out = []
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))
        out.append(F.to_json(F.col(f.name)).alias(f.name) if nested and f.name not in keep else F.col(f.name))
    return df.select(*out)


def sync_stamp(df: DataFrame, ts: str) -> DataFrame:
    """``src_sync_stamp``: add the ``_synced_at`` load timestamp."""
    return df.withColumn("_synced_at", F.lit(ts).cast("timestamp_ntz"))


def watermark_filter(df: DataFrame, col: str, high_watermark) -> DataFrame:
    """``src_watermark_filter``: rows strictly above the stored high watermark
    (a plain comparison, pushed down to the Parquet scan)."""
    if high_watermark is None:
        return df
    return df.filter(F.col(col) > F.lit(high_watermark).cast(df.schema[col].dataType))


def watermark_state(batches: dict[str, tuple[DataFrame, str]], synced_at: str) -> DataFrame:
    """``src_watermark_state``: per table max watermark and rows synced."""
    parts = []
    for table, (df, col) in batches.items():
        parts.append(df.agg(F.max(F.col(col)).cast("timestamp_ntz").alias("high_watermark"),
                            F.count(F.lit(1)).alias("rows_synced"))
                     .select(F.lit(table).alias("table_name"), "high_watermark", "rows_synced",
                             F.lit(synced_at).cast("timestamp_ntz").alias("last_synced_at")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """Latest-wins merge of watermark state rows (by table)."""
    return upsert_latest(state, new, ["table_name"])


def upsert_latest(base: DataFrame, delta: DataFrame, keys: Sequence[str],
                  order: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``src_upsert_latest``: merge by key, the incoming row wins, untouched
    base rows are kept.

    A key that comes several times in one delivery is reduced to its latest row
    under ``order`` (``(column, "asc" | "desc")`` pairs, first row wins); without
    an order to its greatest row, so the result never depends on arrival.  The
    reduction is a partial aggregate and the merge a keyed anti-join plus union:
    no key is ever gathered into one task.
    """
    rows = delta.select(*dict.fromkeys([*base.columns, *[c for c, _ in order]]))
    rest = [c for c in rows.columns if c not in keys and c not in {o for o, _ in order}
            and not isinstance(rows.schema[c].dataType, T.MapType)]
    latest = latest_per_key(rows, list(keys), [*order, *[(c, "desc") for c in rest]]) if order or rest \
        else rows.dropDuplicates(list(keys))
    kept = base.join(delta.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(latest.select(*base.columns))


#: Error classes that say a source is not there; any other failure is raised.
_ABSENT = {"PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"}


def optional_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """``src_optional_table``: the table if it exists, else an empty typed relation.

    Only a missing path or table counts as absent; an unknown format, missing
    rights or a broken catalog are errors.
    """
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() not in _ABSENT:
            raise
        return spark.createDataFrame([], schema)


#: Column holding the text of a line that does not fit the declared schema.
CORRUPT = "_corrupt_record"


def read_csv_seed(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """``src_csv_seed``: typed CSV seed (header row, declared schema, no inference); a malformed line fails the read."""
    return spark.read.option("header", True).option("mode", mode).schema(schema).csv(path)


def split_csv_seed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``src_csv_seed`` for files that may hold bad lines: the typed rows, and a reject
    table (``source_file``, ``line``) of the lines that do not parse under the schema.

    Every column is parsed whatever a query selects, so a line is either a row
    or a reject in all of them.
    """
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("columnPruning", False).schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).csv(path))
    # Spark refuses plans that read nothing but the corrupt record; the test holds for every row.
    raw = raw.withColumn(CORRUPT, F.when(F.hash(*schema.names) <= 2**31 - 1, F.col(CORRUPT)))
    bad = F.col(CORRUPT).isNotNull()
    rejects = raw.where(bad).select(F.col("_metadata.file_name").alias("source_file"), F.col(CORRUPT).alias("line"))
    return raw.where(~bad).select(*schema.names), rejects


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``src_row_counts``: one row per table with its row count."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """``src_preview``: first n rows (n clamped to 1..100); non-scalar values as text."""
    n = max(1, min(100, int(n)))
    cols = []
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))
        cols.append(F.col(f.name).cast("string").alias(f.name) if nested else F.col(f.name))
    return df.orderBy(*order_by).limit(n).select(*cols)
