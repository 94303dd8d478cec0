"""The business snapshot and what it is summed from, on rows of their own."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__ as E
from meridian.operators import shapes
from meridian.plans.finance import fin_monthly_revenue, revenue_facts
from meridian.sources.bindings import Bindings
from meridian.sources.tables import SCHEMAS
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """Tables with a busy organisation, several sessions a day, and movements before the first session and after ``as_of``."""
    d, rnd = str(tmp_path_factory.mktemp("own")), random.Random(11)
    segments = ("MACHINERY", "BUILDING", "AUTOMOBILE")
    orders, lines = [], []
    for k in range(1, 161):
        at = dt.datetime(2000, 11, 20) + dt.timedelta(days=rnd.choice([0, 0, 1, rnd.randint(0, 330)]))  # some after 2001-08-01
        orders.append((k, 4 if k % 3 == 0 else rnd.randint(1, 12), rnd.choice("FOP"), rnd.randint(100, 90000) / 100, at, rnd.choice(["1-URGENT", "2-HIGH", "5-LOW"])))
        for n in range(1, rnd.randint(1, 5)):
            lines.append((k, rnd.randint(1, 3), rnd.randint(1, 3), n, 1.0, rnd.randint(100, 90000) / 100, 0.0, 0.0, rnd.choice("ANR"), rnd.choice("FO"), at + dt.timedelta(days=rnd.randint(1, 90))))
    rows = {
        "region": [(0, "AFRICA")], "nation": [(0, "ALGERIA", 0), (1, "KENYA", 0)],
        "customer": [(k, f"Customer#{k}", k % 2, 10.0 * k, segments[k % 3]) for k in range(1, 13)],
        "supplier": [(k, f"Supplier#{k}", 0, 1.0) for k in range(1, 4)], "part": [(k, "p", f"Brand#{k}", "t", 1, 1.0) for k in range(1, 4)],
        "orders": orders, "lineitem": lines, "events": [(1, dt.datetime(2024, 1, 3), 7, "view", 1.0, "{}")],
    }
    for t, r in rows.items():
        spark.createDataFrame(r, SCHEMAS[t]).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


def _plain(rows):
    return sorted(repr(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)) for r in rows)


def test_snapshot_equals_its_twin(spark, own):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{own}/{t}.parquet/*.parquet')")
    df = E.queries()["term_business_snapshot"](spark, own)
    names = ", ".join(df.columns)
    want = con.execute(f"SELECT {names} FROM ({E.oracle_sql()['term_business_snapshot']})").fetchall()
    got = df.collect()
    assert len(got) == len(want) == 12 * 10 and _plain(got) == _plain(want)
    # Days are counted once, however many sessions they have; the calendar ends with as_of.
    assert any(r.total_runs > r.active_days_in_month > 1 for r in got) and max(r.month_start for r in got) == dt.date(2001, 8, 1)


def test_accounts_meet_orders_before_lines(spark, own):
    b = Bindings(spark, own)
    accounts = spark.createDataFrame([(1, 10), (2, None), (3, 30), (3, 31), (4, 40), (99, 990)], "account_id long, organization_id long")  # 3 comes twice, most not at all
    want = b.opportunities.join(accounts, "account_id")
    got = b.account_opportunities(accounts).select(want.columns)
    assert got.count() > 50 and _plain(got.collect()) == _plain(want.collect())


def test_revenue_facts_of_a_stored_table_are_those_of_invoices(spark, own):
    b = Bindings(spark, own)
    cell = ["organization_id", "month_start"]
    plain = revenue_facts(b).groupBy(*cell).agg(F.sum("_paid"), F.sum("_billed")).collect()
    rows = fin_monthly_revenue(b)
    b.stored["fin_monthly_revenue"] = rows.unionByName(rows)  # an organisation that comes twice has its months twice
    assert len(plain) > 20 and _plain(revenue_facts(b).select(*cell, "_paid", "_billed").collect()) == _plain(plain)


def test_dated_measures_keep_keys(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 5), dt.date(2020, 2, 1), 3), (2, dt.date(2020, 1, 9), None, 4), (None, None, None, 5)], "k int, a date, b date, n int")
    out = shapes.dated_measures(df, [("a", {"made": F.col("n")}), ("b", {"done": F.lit(1)})], "MM", "m", ["k"])
    jan, feb = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    assert {tuple(r) for r in out.collect()} == {(1, jan, 3, None), (1, feb, None, 1), (2, jan, 4, None)}
