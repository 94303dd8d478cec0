"""Library operators that work on metadata, files or fixed configuration."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.operators import catalog as C
from meridian.operators import quality as Q
from meridian.plans import registry as R
from meridian.plans.terminal import METRIC_REGISTRY_ROWS, REGISTRY_SCHEMA
from meridian.sources import ingest, sinks
from meridian.sources.tables import SCHEMAS

SF = "/root/testdata/sf0.001"


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="meridian-lib-"), name)


def test_column_catalog_sensitivity(spark):
    cat = C.column_catalog(spark, {"customer": SCHEMAS["customer"], "orders": SCHEMAS["orders"]})
    cls = {(r.table_name, r.column_name): r.sensitivity for r in cat.collect()}
    assert cls[("customer", "c_name")] == "pii"
    assert cls[("orders", "o_totalprice")] == "standard"
    assert cat.count() == len(SCHEMAS["customer"].fields) + len(SCHEMAS["orders"].fields)


def test_lineage_edges_from_registry(spark):
    R.load_all()
    edges = C.lineage_edges(spark, R.INPUTS)
    ups = {r.upstream for r in edges.filter(F.col("downstream") == "fin_firm_unit_economics").collect()}
    assert "fin_customer_unit_economics" in ups
    assert edges.count() > 100


def test_metric_catalog_and_registry_contract(spark):
    reg = spark.createDataFrame(METRIC_REGISTRY_ROWS, REGISTRY_SCHEMA)
    assert C.metric_catalog(reg).count() == len(METRIC_REGISTRY_ROWS)
    assert Q.registry_contract(reg).count() == 0
    bad = spark.createDataFrame([("x", "finance", "hourly", "m", " ", "o", True)], REGISTRY_SCHEMA)
    checks = {r.check_name for r in Q.registry_contract(bad).collect()}
    assert checks == {"grain_invalid", "definition_missing"}


def test_schema_drift_and_contract(spark):
    base = Q.schema_frame(spark, {"orders": SCHEMAS["orders"]})
    changed = T.StructType([f for f in SCHEMAS["orders"].fields if f.name != "o_orderpriority"]
                           + [T.StructField("o_clerk", T.StringType())])
    changed = T.StructType([T.StructField(f.name, T.StringType() if f.name == "o_totalprice" else f.dataType)
                            for f in changed.fields])
    cur = Q.schema_frame(spark, {"orders": changed})
    drift = {(r.column_name, r.change) for r in Q.schema_drift(base, cur).collect()}
    assert drift == {("o_clerk", "added"), ("o_orderpriority", "removed"), ("o_totalprice", "type_changed")}
    assert Q.schema_contract(base, base).count() == 0
    assert Q.schema_contract(base, cur).count() == 3


def test_optional_table_and_column(spark):
    empty = ingest.optional_table(spark, _tmp("missing"), SCHEMAS["orders"])
    assert empty.count() == 0 and empty.schema == SCHEMAS["orders"]
    o = spark.read.parquet(f"{SF}/orders.parquet")
    got = o.select(ingest.col_or_null(o, "nope", "int"))
    assert got.schema.fields[0].dataType == T.IntegerType()
    assert got.filter(F.col("nope").isNotNull()).count() == 0


def test_sinks_roundtrip(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").withColumn("m", F.date_format("o_orderdate", "yyyyMM"))
    t = sinks.materialize(o, "orders_core", "core", _tmp("orders_core"), partition_by=["m"])
    assert t.count() == o.count()
    v = sinks.materialize(o, "orders_view", "gold")
    assert spark.table("orders_view").count() == o.count() and v is o
    path = _tmp("replaced")
    sinks.atomic_replace(o.limit(10), path)
    sinks.atomic_replace(o.limit(20), path)
    assert sinks.read_table(spark, path).count() == 20
    audit = _tmp("audit")
    sinks.append_jsonl(o.select("o_orderkey").limit(5), audit)
    sinks.append_jsonl(o.select("o_orderkey").limit(5), audit)
    assert spark.read.json(audit).count() == 10
    csv = _tmp("export")
    sinks.export_csv(o.select("o_orderkey", "o_orderstatus").limit(7), csv)
    assert spark.read.option("header", True).csv(csv).count() == 7


def test_layer_materialization_cuts_lineage(spark):
    from meridian.plans import layers
    from meridian.sources.bindings import Bindings

    b = Bindings(spark, SF)
    out = layers.materialize(b, {"fct_sessions": ("session_month",), "dim_organizations": ()}, base=_tmp("wh"))
    s = out["fct_sessions"]
    assert s.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "lineitem" not in plan
    assert s.columns == R.QUERIES["fct_sessions"](Bindings(spark, SF)).columns
    # A product above the layer reads the stored fact, not the raw tables it was made from.
    gold = R.QUERIES["eng_daily"](b)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in gold and "/fct_sessions" in R.QUERIES["eng_daily"](b)._jdf.queryExecution().executedPlan().toString()


def test_warehouse_build_and_quality_gate(spark):
    from meridian.build import build

    out = _tmp("warehouse")
    report = build(spark, SF, out, gold=("fin_monthly_revenue", "eng_daily"))
    rows = {r.check_name: r for r in report.collect()}
    assert len(rows) >= 20 and not any(r.failed for r in rows.values())
    assert rows["dq_unique"].violations > 0  # duplicated (orderkey, linenumber) event ids are reported, not blocking
    assert spark.read.parquet(f"{out}/gold/eng_daily").count() > 0
    assert spark.read.parquet(f"{out}/core/fct_sessions").count() > 0


def test_every_planted_check_is_clean_without_plants(spark):
    import inspect

    from meridian.sources.bindings import Bindings

    b = Bindings(spark, SF)
    planted = [n for n, f in R.QUERIES.items() if "planted" in inspect.signature(f).parameters]
    assert len(planted) >= 12
    for n in planted[:4]:
        assert R.QUERIES[n](b, planted=False).count() == 0 and R.QUERIES[n](b).count() > 0


def test_row_checks_share_one_scan_a_table_and_count_alike(spark, monkeypatch):
    from meridian.plans import quality_q
    from meridian.sources.bindings import Bindings

    b = Bindings(spark, SF)
    counts = quality_q.row_check_counts(b)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [count(1)") == len(quality_q.ROW_RULES)
    got = {}
    for r in counts.collect():
        got[r.suite] = got.get(r.suite, 0) + r.violations
    assert len(got) == 9 and got == {n: R.QUERIES[n](b, planted=False).count() if n != "dq_not_null" else R.QUERIES[n](b).count() for n in got}
    rows = spark.createDataFrame([(1, None, 5), (2, 7, None), (3, None, None), (4, 1, 1)], "k int, a int, b int")
    rules = {"a_null": F.col("a").isNull(), "a_big": F.col("a") > 5, "b_one": F.col("b") == 1}
    tallied = Q.violation_counts({"t": (rows, {("s", n): p for n, p in rules.items()})})
    assert {r.check_name: (r.violations, r.rows_checked) for r in tallied.collect()} == {"a_null": (2, 4), "a_big": (1, 4), "b_one": (1, 4)}
    listed = Q.predicates(rows, rules, ["k"])
    assert sorted((r.check_name, r.k) for r in listed.collect()) == [("a_big", 2), ("a_null", 1), ("a_null", 3), ("b_one", 4)]
    assert "Union" not in listed._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_reduces_repeated_keys_in_one_delta(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    delta = spark.createDataFrame([(1, "old", 2), (1, "new", 3), (3, "x", 1), (3, "x", 1)], "k int, v string, t int")
    got = sorted(tuple(r) for r in ingest.upsert_latest(base, delta, ["k"], [("t", "desc")]).collect())
    assert got == [(1, "new", 3), (2, "b", 1), (3, "x", 1)]
    assert ingest.upsert_latest(base, delta, ["k"]).count() == 3


def test_optional_table_raises_on_other_errors(spark):
    import pytest

    with pytest.raises(Exception, match="parquett"):
        ingest.optional_table(spark, f"{SF}/orders.parquet", SCHEMAS["orders"], fmt="parquett")


def test_failed_replace_leaves_the_old_table(spark, monkeypatch):
    import pytest

    path = _tmp("kept")
    o = spark.read.parquet(f"{SF}/orders.parquet")
    sinks.atomic_replace(o.limit(10), path)
    broken = o.select(F.raise_error(F.lit("boom")).cast("int").alias("x"))
    with pytest.raises(Exception, match="boom"):
        sinks.atomic_replace(broken, path)
    assert sinks.read_table(spark, path).count() == 10


def test_csv_seed_reads_a_stored_seed(spark):
    path = _tmp("seed")
    spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    got = ingest.read_csv_seed(spark, path, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))
    assert got.count() == 25 and got.filter("id is null").count() == 0


def test_csv_seed_routes_malformed_lines_to_rejects(spark):
    path = _tmp("bad_seed")
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as f:
        f.write('id,name,day\n1,one,2024-01-01\nx2,two,2024-01-02\n3,"a, quoted",2024-01-03\n4,four,not a day\n5\n,,\n6,six,2024-01-06,more\n')
    with open(f"{path}/b.csv", "w") as f:
        f.write("id,name,day\n7,seven,2024-01-07\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType())])
    good, rejects = ingest.split_csv_seed(spark, path, schema)
    assert sorted((r.id or 0, r.name) for r in good.collect()) == [(0, None), (1, "one"), (3, "a, quoted"), (7, "seven")]
    assert good.dtypes == [("id", "int"), ("name", "string"), ("day", "date")]
    lines = {"x2,two,2024-01-02", "4,four,not a day", "5", "6,six,2024-01-06,more"}
    assert {(r.source_file, r.line) for r in rejects.collect()} == {("a.csv", x) for x in lines}
    assert good.select("name").count() == 4 and rejects.count() == 4
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.read_csv_seed(spark, path, schema).collect()


def test_task_execution_processes_every_pending_task(spark):
    from meridian.plans.growth import task_execution

    queue = spark.range(250).select(
        F.concat(F.lit("t"), "id").alias("task_id"), F.concat(F.lit("s"), "id").alias("signal_id"), F.col("id").alias("organization_id"),
        F.lit("a").alias("action_type"), F.lit("high").alias("priority"), F.lit("r").alias("reason_code"),
        F.lit(0.8).alias("signal_score"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    log = queue.limit(30).select("task_id", "signal_id")
    assert task_execution(queue, log, "2001-08-01").count() == 220
    assert task_execution(queue, log, "2001-08-01", limit=50).count() == 50
