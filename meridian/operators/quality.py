"""Data-quality operators.  Every check returns the *violating* rows (empty =
pass), tagged with a ``check_name``; all are distributed filters, anti-joins
or grouped aggregates over the checked relation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tag(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), *df.columns)


def not_null(df: DataFrame, cols: Sequence[str], keys: Sequence[str], name: str = "not_null") -> DataFrame:
    """Rows where any of ``cols`` is NULL, with the first offending column."""
    first_null = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    v = df.filter(first_null.isNotNull()).select(*keys, first_null.alias("null_column"))
    return _tag(v, name)


def unique(df: DataFrame, keys: Sequence[str], name: str = "unique") -> DataFrame:
    """Key values occurring more than once (also the composite-grain check)."""
    v = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)
    return _tag(v, name)


def accepted_values(df: DataFrame, col: str, values: Iterable, keys: Sequence[str],
                    name: str = "accepted_values") -> DataFrame:
    v = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*list(values))).select(*keys, col)
    return _tag(v, name)


def relationships(child: DataFrame, fk: str, parent: DataFrame, pk: str, keys: Sequence[str],
                  name: str = "relationships") -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent (anti-join)."""
    p = parent.select(F.col(pk).alias("__pk")).distinct()
    v = child.filter(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("__pk"), "left_anti").select(*keys, fk)
    return _tag(v, name)


def predicates(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Rows that violate rules, once for each rule; ``rules`` maps a check name to a
    violation predicate.  All rules are evaluated in one pass over ``df``."""
    names = F.array_compact(F.array(*[F.when(pred, F.lit(name)) for name, pred in rules.items()]))
    return df.select(F.explode(names).alias("check_name"), *keys)


def violation_counts(tables: dict[str, tuple[DataFrame, dict[tuple[str, str], Column]]]) -> DataFrame:
    """``table_name, suite, check_name, violations, rows_checked`` of every row-level check.

    ``tables`` maps a table to its rows and its checks: ``(suite, check name)``
    to a violation predicate.  The checks of a table are compiled into one
    aggregate, so a table is read once however many checks it has, and nothing
    but counts leaves the tasks; violating rows are listed by ``predicates``.
    """
    parts = []
    for table, (df, checks) in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(pred, F.lit(False))).alias(f"c{i}") for i, pred in enumerate(checks.values())])
        rows = [F.struct(F.lit(suite).alias("suite"), F.lit(check).alias("check_name"), F.col(f"c{i}").alias("violations")) for i, (suite, check) in enumerate(checks)]
        parts.append(counted.select(F.lit(table).alias("table_name"), "n", F.explode(F.array(*rows)).alias("r"))
                     .select("table_name", "r.*", F.col("n").alias("rows_checked")))
    return reduce(lambda x, y: x.unionByName(y), parts)


def single_row(df: DataFrame, name: str = "single_row") -> DataFrame:
    v = df.agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") != 1)
    return _tag(v, name)


def recompute_compare(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str,
                      tolerance: float = 0.01, name: str = "recompute") -> DataFrame:
    """FULL OUTER comparison of an independent recomputation against a mart."""
    e = expected.select(*keys, F.col(value).alias("expected_value"))
    a = actual.select(*keys, F.col(value).alias("actual_value"))
    j = e.join(a, list(keys), "full")
    diff = F.abs(F.coalesce("expected_value", F.lit(0.0)) - F.coalesce("actual_value", F.lit(0.0)))
    return _tag(j.filter(diff > tolerance).select(*keys, "expected_value", "actual_value"), name)


def freshness(tables: dict[str, tuple[DataFrame, str, str]], thresholds: dict[str, float], as_of_ts: str,
              default_hours: float = 24.0) -> DataFrame:
    """Per table: max timestamp, rows, age in hours, threshold (by table, then
    by layer, then default) and a stale flag; an empty table is stale."""
    parts = []
    for table, (df, col, layer) in tables.items():
        limit = thresholds.get(table, thresholds.get(layer, default_hours))
        a = df.agg(F.max(F.col(col)).alias("max_ts"), F.count(F.lit(1)).alias("row_count"))
        parts.append(a.select(F.lit(table).alias("table_name"), F.lit(layer).alias("layer"), "max_ts", "row_count",
                              F.round(F.timestamp_diff("SECOND", F.col("max_ts"), F.lit(as_of_ts).cast("timestamp_ntz"))
                                      / 3600.0, 2).alias("age_hours"),
                              F.lit(float(limit)).alias("threshold_hours")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("is_stale", (F.col("row_count") == 0) | F.col("max_ts").isNull()
                          | (F.col("age_hours") > F.col("threshold_hours")))


def completeness(df: DataFrame, cols: Sequence[str], date_col: str, as_of: str, days: int = 90,
                 min_share: float = 0.95) -> DataFrame:
    """Share of non-NULL values per column over the trailing window; rows below the bar."""
    recent = df.filter(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), days))
    aggs = [F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias(c) for c in cols]
    wide = recent.agg(*aggs)
    long = wide.unpivot([], list(cols), "column_name", "non_null_share")
    return (long.select(F.lit("completeness").alias("check_name"), "column_name",
                        F.round("non_null_share", 4).alias("non_null_share"))
            .filter(F.col("non_null_share") < min_share))


def schema_frame(spark, schemas: dict[str, T.StructType]) -> DataFrame:
    """(table, column, type, nullable) rows for a set of schemas (a catalog)."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, s in schemas.items() for f in s.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_nullable boolean")


def schema_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Added / removed columns (set difference both ways) and type or
    nullability changes on common columns (intersection + compare)."""
    k = ["table_name", "column_name"]
    added = current.join(baseline, k, "left_anti").select(*k, F.lit("added").alias("change"))
    removed = baseline.join(current, k, "left_anti").select(*k, F.lit("removed").alias("change"))
    b = baseline.select(*k, F.col("data_type").alias("b_type"), F.col("is_nullable").alias("b_null"))
    both = current.join(b, k, "inner")
    changed = both.filter((F.col("data_type") != F.col("b_type")) | (F.col("is_nullable") != F.col("b_null"))) \
        .select(*k, F.when(F.col("data_type") != F.col("b_type"), F.lit("type_changed"))
                .otherwise(F.lit("nullability_changed")).alias("change"))
    return added.unionByName(removed).unionByName(changed)


def schema_contract(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (model, column, type) vs actual: missing, unexpected or mistyped."""
    k = ["table_name", "column_name"]
    e = expected.select(*k, F.col("data_type").alias("expected_type"))
    a = actual.select(*k, F.col("data_type").alias("actual_type"))
    j = e.join(a, k, "full")
    return j.filter(F.col("expected_type").isNull() | F.col("actual_type").isNull()
                    | (F.col("expected_type") != F.col("actual_type")))


# Allowed metric grains and domains in the registry contract.
REGISTRY_GRAINS = ("day", "week", "month", "snapshot")
REGISTRY_DOMAINS = ("finance", "product", "engineering", "growth", "operations")


def registry_contract(registry: DataFrame) -> DataFrame:
    """Required metric metadata present, non-blank and within the allowed values."""
    c = F.col
    blank = lambda x: c(x).isNull() | (F.trim(c(x)) == "")
    rules = {
        "metric_name_missing": blank("metric_name"),
        "owner_missing": blank("owner"),
        "definition_missing": blank("definition"),
        "grain_invalid": ~c("grain").isin(*REGISTRY_GRAINS) | c("grain").isNull(),
        "domain_invalid": ~c("domain").isin(*REGISTRY_DOMAINS) | c("domain").isNull(),
    }
    return predicates(registry, rules, ["metric_name"])
