"""Catalog, monitoring and governance operators.

Catalogs are DataFrames built from schemas (metadata) joined with aggregates
over the data itself (row counts, freshness); search is a union of filtered
scans; masking is a projection driven by the column sensitivity class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column-name fragments that classify a column's sensitivity.
PII_MARKERS = ("email", "full_name", "first_name", "last_name", "organization_name", "account_name", "c_name",
               "phone", "address")
SECRET_MARKERS = ("secret", "token", "password", "stripe", "key_hash")
# Preferred freshness columns, best first.
FRESHNESS_PRIORITY = ("updated_at", "_synced_at", "created_at", "ts", "occurred_at", "event_at")


def sensitivity(column_name: str) -> str:
    n = column_name.lower()
    if any(m in n for m in SECRET_MARKERS):
        return "secret"
    if any(m in n for m in PII_MARKERS):
        return "pii"
    return "standard"


def column_catalog(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    """``cat_columns``: one row per column with type, position and sensitivity class."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString(), f.nullable, sensitivity(f.name))
            for t, s in schemas.items() for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, "
                                       "data_type string, is_nullable boolean, sensitivity string")


def freshness_column(schema: T.StructType) -> str | None:
    """Best freshness candidate: priority list first, then any timestamp column."""
    names = {f.name: f.dataType for f in schema.fields}
    for cand in FRESHNESS_PRIORITY:
        if cand in names:
            return cand
    for f in schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f.name
    return None


def table_catalog(tables: dict[str, DataFrame], owners: dict[str, str] | None = None,
                  certified: Sequence[str] = ()) -> DataFrame:
    """``cat_tables``: row count, column count, freshness column and its max value."""
    owners = owners or {}
    parts = []
    for name, df in tables.items():
        fc = freshness_column(df.schema)
        mx = F.max(F.col(fc)).cast("timestamp_ntz") if fc else F.lit(None).cast("timestamp_ntz")
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), mx.alias("max_freshness")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
            F.lit(fc).cast("string").alias("freshness_column"), "max_freshness",
            F.lit(owners.get(name, "data-platform")).alias("owner"), F.lit(name in certified).alias("is_certified")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lineage_edges(spark: SparkSession, inputs: dict[str, Sequence[str]]) -> DataFrame:
    """``cat_lineage``: (upstream, downstream) edges from the query registry."""
    rows = [(up, down) for down, ups in inputs.items() for up in ups]
    return spark.createDataFrame(rows, "upstream string, downstream string")


def metric_catalog(registry: DataFrame) -> DataFrame:
    """``cat_metrics``: certified metric definitions, one row per metric."""
    return registry.select("metric_name", "domain", "grain", "source_model", "definition", "owner", "is_certified")


def search(sources: Sequence[tuple[str, DataFrame, str, Column, Column]], term: str, limit: int) -> DataFrame:
    """``cat_search``: each source is (kind, frame, id column, text column, label);
    rows whose text contains ``term`` (whole text), tagged, ordered, limited to
    ``limit`` rows (1 to 100)."""
    out = None
    for kind, df, id_col, text, label in sources:
        hits = df.filter(text.contains(term)).select(F.lit(kind).alias("match_kind"),
                                                     F.col(id_col).cast("long").alias("object_id"),
                                                     label.cast("string").alias("label"))
        out = hits if out is None else out.unionByName(hits)
    return out.orderBy("match_kind", "object_id").limit(max(1, min(100, int(limit))))


def mask_sensitive(df: DataFrame) -> DataFrame:
    """``gov_mask_sensitive``: PII hashed (SHA-256), secrets nulled, rest kept."""
    cols = []
    for f in df.schema.fields:
        cls = sensitivity(f.name)
        if cls == "pii":
            cols.append(F.sha2(F.col(f.name).cast("string"), 256).alias(f.name))
        elif cls == "secret":
            cols.append(F.lit(None).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``cat_columns`` with data: per column its type, position, sensitivity
    class, row count and NULL count (one aggregate per table, unpivoted)."""
    out = None
    for name, df in tables.items():
        fields = df.schema.fields
        agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                     *[(F.count(F.lit(1)) - F.count(F.col(f.name))).alias(f"__n{i}") for i, f in enumerate(fields)])
        long = agg.select("__rows", F.explode(F.array(*[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("ordinal_position"),
                     F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.lit(sensitivity(f.name)).alias("sensitivity"), F.col(f"__n{i}").alias("null_count"))
            for i, f in enumerate(fields)])).alias("c"))
        part = long.select(F.lit(name).alias("table_name"), "c.column_name", "c.ordinal_position", "c.data_type",
                           "c.sensitivity", F.col("__rows").alias("row_count"), "c.null_count")
        out = part if out is None else out.unionByName(part)
    return out
