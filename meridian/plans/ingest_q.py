"""Source/ingest operator queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import ingest
from ..sources.tables import TABLE_NAMES
from .registry import register

HIGH_WATERMARK = "2001-01-01 00:00:00"
SYNCED_AT = "2001-08-01 00:00:00"


@register("src_typed_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def src_typed_scan(b):
    return b.t.scan("orders")


@register("src_full_extract", "SELECT * FROM customer")
def src_full_extract(b):
    return b.t.customer


ORDERS_DEST = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_clerk", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_shippriority", T.IntegerType()),
])


@register("src_align_columns", """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS VARCHAR) AS o_clerk, o_totalprice,
       CAST(NULL AS INTEGER) AS o_shippriority FROM orders""")
def src_align_columns(b):
    return ingest.align_columns(b.t.orders, ORDERS_DEST)


@register("src_json_encode_nested", """SELECT api_key_id, scopes, CAST(to_json({'organization_id': organization_id, 'status': status}) AS VARCHAR)
       AS settings FROM b_api_keys""", ("b_api_keys",))
def src_json_encode_nested(b):
    a = b.api_keys.select("api_key_id", "scopes", F.struct("organization_id", "status").alias("settings"))
    return ingest.json_encode_nested(a, keep=["scopes"])


@register("src_sync_stamp", f"SELECT *, TIMESTAMP '{SYNCED_AT}' AS _synced_at FROM orders")
def src_sync_stamp(b):
    return ingest.sync_stamp(b.t.orders, SYNCED_AT)


@register("src_watermark_filter", f"SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '{HIGH_WATERMARK}'")
def src_watermark_filter(b):
    return ingest.watermark_filter(b.t.orders, "o_orderdate", HIGH_WATERMARK)


@register("src_watermark_state", f"""
SELECT 'orders' AS table_name, max(o_orderdate) AS high_watermark, count(*) AS rows_synced,
       TIMESTAMP '{SYNCED_AT}' AS last_synced_at FROM orders WHERE o_orderdate > TIMESTAMP '{HIGH_WATERMARK}'
UNION ALL SELECT 'lineitem', max(l_shipdate), count(*), TIMESTAMP '{SYNCED_AT}' FROM lineitem
  WHERE l_shipdate > TIMESTAMP '{HIGH_WATERMARK}'
UNION ALL SELECT 'events', max(ts), count(*), TIMESTAMP '{SYNCED_AT}' FROM events""")
def src_watermark_state(b):
    batches = {"orders": (ingest.watermark_filter(b.t.orders, "o_orderdate", HIGH_WATERMARK), "o_orderdate"),
               "lineitem": (ingest.watermark_filter(b.t.lineitem, "l_shipdate", HIGH_WATERMARK), "l_shipdate"),
               "events": (b.t.events, "ts")}
    return ingest.watermark_state(batches, SYNCED_AT)


@register("src_upsert_latest", """
SELECT invoice_id, organization_id, invoice_status, paid_at FROM b_invoices
WHERE invoice_id NOT IN (SELECT invoice_id FROM b_invoices WHERE invoice_status = 'open')
UNION ALL
SELECT invoice_id, organization_id, 'paid' AS invoice_status, created_at + INTERVAL 7 DAY AS paid_at
FROM b_invoices WHERE invoice_status = 'open'""", ("b_invoices",))
def src_upsert_latest(b):
    base = b.invoices.select("invoice_id", "organization_id", "invoice_status", "paid_at")
    delta = (b.invoices.filter(F.col("invoice_status") == "open")
             .select("invoice_id", "organization_id", F.lit("paid").alias("invoice_status"),
                     F.timestamp_add("DAY", F.lit(7), F.col("created_at")).alias("paid_at")))
    return ingest.upsert_latest(base, delta, ["invoice_id"], [("paid_at", "desc")])


@register("src_optional_column", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_clerk, o_orderpriority FROM orders")
def src_optional_column(b):
    o = b.t.orders
    return o.select("o_orderkey", ingest.col_or_null(o, "o_clerk", "string"),
                    ingest.col_or_null(o, "o_orderpriority", "string"))


SEED_SCHEMA = T.StructType([T.StructField("nation_id", T.IntegerType()), T.StructField("nation_name", T.StringType()),
                            T.StructField("region_id", T.IntegerType())])


@register("src_csv_seed", """
SELECT TRUE AS is_row, n_nationkey AS nation_id, n_name AS nation_name, n_regionkey AS region_id, NULL AS line FROM nation
UNION ALL SELECT FALSE, NULL, NULL, NULL, 'x' || n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT FALSE, NULL, NULL, NULL, n_nationkey || ',' || n_name FROM nation WHERE n_nationkey % 7 = 0""")
def src_csv_seed(b):
    """A CSV seed read from its file: typed rows, and the lines that are none.

    The file is written from ``nation`` under the shared folder, with lines
    whose id is no number and lines that end early among the others.
    """
    path = scratch_path(b.spark, f"seeds/nation-{uuid.uuid4().hex}")
    n = b.t.nation
    line = lambda key: F.concat_ws(",", key, "n_name", F.col("n_regionkey").cast("string"))
    key = F.col("n_nationkey").cast("string")
    lines = n.select(line(key).alias("value")).unionByName(n.where("n_nationkey % 5 = 0").select(line(F.concat(F.lit("x"), key)).alias("value"))) \
        .unionByName(n.where("n_nationkey % 7 = 0").select(F.concat_ws(",", key, "n_name").alias("value")))
    header = b.spark.createDataFrame([(",".join(SEED_SCHEMA.names),)], "value string")
    header.unionByName(lines).coalesce(1).write.text(path)  # a seed is one small file
    rows, rejects = ingest.split_csv_seed(b.spark, path, SEED_SCHEMA)
    return rows.select(F.lit(True).alias("is_row"), "*", F.lit(None).cast("string").alias("line")).unionByName(
        rejects.select(F.lit(False).alias("is_row"), "line"), allowMissingColumns=True)


@register("src_row_counts", "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
                                                 for t in TABLE_NAMES))
def src_row_counts(b):
    return ingest.row_counts({t: b.t.scan(t) for t in TABLE_NAMES})


@register("src_preview", """SELECT api_key_id, organization_id, '[' || array_to_string(scopes, ', ') || ']' AS scopes, status, created_at
FROM b_api_keys ORDER BY api_key_id LIMIT 20""", ("b_api_keys",))
def src_preview(b):
    return ingest.preview(b.api_keys, 20, ["api_key_id"])
