"""Custom DataFrame shapes vs brute force on random data with a hot key and ties."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.operators import shapes
from meridian.plans.streaming_q import sessionize_batch


def _rows(seed, n=600):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        key = 0 if rnd.random() < 0.34 else rnd.randint(1, 25)  # key 0 holds about a third of the rows
        ts = base + dt.timedelta(minutes=rnd.choice([rnd.randint(0, 60 * 24 * 40), 60 * 24 * 3]))  # many ties
        out.append((key, i, ts, rnd.randint(0, 500) if rnd.random() > 0.1 else None))
    return out


def _df(spark, seed):
    return spark.createDataFrame(_rows(seed), "k long, id long, ts timestamp_ntz, v int")


def test_latest_per_key_matches_row_number(spark):
    for seed in range(3):
        df = _df(spark, seed)
        for order in ([("ts", "desc"), ("id", "desc")], [("ts", "asc"), ("id", "asc")], [("v", "desc"), ("id", "asc")],
                      [("v", "asc"), ("ts", "desc"), ("id", "asc")]):
            got = {tuple(r) for r in shapes.latest_per_key(df, ["k"], order).collect()}
            w = Window.partitionBy("k").orderBy(*[F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last()
                                                  for c, d in order])
            want = {tuple(r) for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").collect()}
            assert got == want


def test_mixed_orders_need_no_window(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2020, 1, 2), -(1 << 63), 0.5), (1, "a", dt.date(2020, 1, 2), 5, None), (1, "b", None, 3, 1.5),
                                (2, None, None, None, None)], "k int, s string, d date, n long, x double")
    for order, first in (([("s", "asc"), ("d", "desc"), ("n", "desc")], 5), ([("s", "desc"), ("d", "asc"), ("n", "asc")], 3), ([("s", "asc"), ("n", "asc"), ("x", "desc")], -(1 << 63))):
        got = shapes.latest_per_key(df, ["k"], order)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.k: r.n for r in got.collect()} == {1: first, 2: None}


def test_dated_measures_and_references(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 5), dt.datetime(2020, 2, 1), 3), (dt.date(2020, 1, 9), None, 4), (None, None, 5)], "a date, b timestamp_ntz, n int")
    out = shapes.dated_measures(df, [("a", {"made": F.lit(1), "n": F.col("n")}), ("b", {"done": F.lit(1)})], "MM", "m")
    got = {tuple(r) for r in out.groupBy("m").agg(F.sum("made"), F.sum("n"), F.sum("done")).collect()}
    assert got == {(dt.date(2020, 1, 1), 2, 7, None), (dt.date(2020, 2, 1), None, None, 1)}
    people = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "id int, name string")
    facts = spark.createDataFrame([(i % 3, 7) for i in range(100)] + [(None, 99)], "owner int, other int")
    assert {r.id for r in shapes.referenced(people, "id", (facts, "owner"), (facts, "other")).collect()} == {0, 1, 2, 7}


def test_percentile_cont_matches_numpy(spark):
    df = _df(spark, 7)
    got = {r.k: (r.p50, r.p95) for r in shapes.percentile_cont(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        vals = g["v"].dropna().astype(float).to_numpy()
        if len(vals) == 0:
            continue
        assert got[k] == (round(float(np.quantile(vals, 0.5)), 2), round(float(np.quantile(vals, 0.95)), 2))


def test_percentile_select_matches_numpy_on_a_hot_real_valued_group(spark):
    rnd = random.Random(6)
    rows = [(0 if i % 3 else rnd.choice([None, 1, 2]), rnd.choice([None, 0.5, rnd.gauss(0, 1e6), rnd.gauss(0, 1e6), rnd.gauss(0, 1e6)])) for i in range(6000)]
    rows += [(3, 7.25), (4, 1.0), (4, 2.0), (5, None)] + [(6, 3.0)] * 50
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = shapes.percentile_select(df, ["k"], "v", probs, ranges=16)
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    want = {}
    for k in {k for k, _ in rows}:
        vals = [v for j, v in rows if j == k and v is not None]
        if vals:
            want[k] = tuple(round(float(np.quantile(vals, p)), 2) for p in probs.values())
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=0.011, rtol=0) for k in want)


def test_percentile_select_looks_into_one_range(spark):
    """No window meets more than a fraction of a hot group's distinct values."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.rand(1).alias("v"))
    plan = shapes.percentile_select(df, ["k"], "v", {"p50": 0.5}, ranges=64)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) >= 2 and all("__r#" in line for line in windows if "__v#" in line)  # values are ordered inside (group, range) only
    counts = df.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1280).alias("s")).first()["s"]
    per_range = np.bincount(np.searchsorted(counts, [r.v for r in df.collect()], side="right"))
    assert per_range.max() < 40_000 / 64 * 2


def test_bucketed_lead_matches_plain_lead(spark):
    df = _df(spark, 11)
    got = {(r.id, r.nxt) for r in shapes.bucketed_lead(df, ["k"], "ts", "id", F.trunc(F.to_date("ts"), "MM"), "nxt")
           .select("id", "nxt").collect()}
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {(r.id, r.nxt) for r in df.select("id", F.lead("ts").over(w).alias("nxt")).collect()}
    assert got == want


def test_sessionize_batch_matches_lag_sum(spark):
    df = spark.createDataFrame([(k, i, ts) for k, i, ts, _ in _rows(3, 800)], "user_id long, event_id long, ts timestamp_ntz")
    gap = 6 * 3600
    got = {tuple(r) for r in sessionize_batch(df, "user_id", "ts", "event_id", gap)
           .select("user_id", "session_start", "last_event_at", "event_count").collect()}
    pdf = df.toPandas().sort_values(["user_id", "ts", "event_id"])
    want = set()
    for u, g in pdf.groupby("user_id"):
        start = last = None
        n = 0
        for ts in g["ts"]:
            if start is None or (ts - last).total_seconds() >= gap:
                if start is not None:
                    want.add((u, start.to_pydatetime(), last.to_pydatetime(), n))
                start, n = ts, 0
            last, n = ts, n + 1
        want.add((u, start.to_pydatetime(), last.to_pydatetime(), n))
    assert got == want


def test_bucketed_asof_matches_brute_force(spark):
    rnd = random.Random(9)
    base = dt.datetime(2020, 1, 1)
    subs = []
    for i in range(120):
        org = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)  # org 0 is hot
        start = base + dt.timedelta(days=rnd.randint(0, 700), hours=rnd.choice([0, 0, 5]))  # same-instant starts
        end = dt.datetime(2999, 12, 31) if rnd.random() < 0.15 else start + dt.timedelta(days=rnd.randint(0, 200))
        subs.append((org, i, start, end))
    sdf = spark.createDataFrame(subs, "org long, sid long, s timestamp_ntz, e timestamp_ntz")
    closed = shapes.close_intervals(sdf, ["org"], "s", "e", [("s", "asc"), ("sid", "asc")], "INTERVAL 1 SECOND", "ce")
    facts = [(rnd.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]), j, base + dt.timedelta(days=rnd.randint(0, 800),
                                                                            hours=rnd.randint(0, 23))) for j in range(900)]
    fdf = spark.createDataFrame(facts, "org long, fid long, ts timestamp_ntz")
    got = {(r.fid, r.sid) for r in shapes.bucketed_asof(fdf, closed, "org", "ts", "s", "ce", ["sid"]).collect()}
    iv = closed.select("org", "sid", "s", "ce").collect()
    want = set()
    for org, fid, ts in facts:
        hits = [r for r in iv if r.org == org and r.s <= ts <= r.ce]
        hits.sort(key=lambda r: (r.s, r.sid), reverse=True)  # latest containing interval, as in the row_number form
        want.add((fid, hits[0].sid if hits else None))
    assert got == want


def test_bucketed_overlap_matches_brute_force(spark):
    rnd = random.Random(21)
    d0 = dt.date(2020, 1, 1)
    periods = []
    for i in range(150):
        k = 0 if rnd.random() < 0.4 else rnd.randint(1, 5)
        s = d0 + dt.timedelta(days=rnd.randint(0, 600))
        periods.append((k, i, s, s + dt.timedelta(days=rnd.randint(0, 90))))
    subs = []
    for j in range(100):
        k = 0 if rnd.random() < 0.4 else rnd.randint(1, 5)
        s = d0 + dt.timedelta(days=rnd.randint(0, 650))
        e = dt.date(2999, 12, 31) if rnd.random() < 0.1 else s + dt.timedelta(days=rnd.randint(-1, 200))  # incl. empty
        subs.append((k, j, s, e))
    pdf = spark.createDataFrame(periods, "k long, pid long, ps date, pe date")
    sdf = spark.createDataFrame(subs, "k long, sid long, ss date, se date")
    got = {(r.pid, r.sid) for r in shapes.bucketed_overlap(pdf, sdf, "k", "ps", "pe", "ss", "se", ["sid"]).collect()}
    want = {(p[1], s[1]) for p in periods for s in subs if p[0] == s[0] and s[2] <= p[3] and s[3] >= p[2]}
    assert got == want


def test_trailing_distinct_multi_matches_brute_force(spark):
    df = _df(spark, 13).select("k", F.to_date("ts").alias("d"))
    got = {r.d: (r.w7, r.w30) for r in shapes.trailing_distinct_multi(df, "k", "d", {"w7": 7, "w30": 30}).collect()}
    active = {(r.k, r.d) for r in df.collect() if r.k is not None and r.d is not None}
    first, last = min(d for _, d in active), max(d for _, d in active)
    want = {}
    for i in range((last - first).days + 30):
        day = first + dt.timedelta(days=i)
        counts = tuple(len({k for k, d in active if day - dt.timedelta(days=n) < d <= day}) for n in (7, 30))
        if max(counts):
            want[day] = counts
    assert got == want


@pytest.mark.parametrize("unit", ["DAY", "MONTH"])
def test_gap_filled_matches_brute_force(spark, unit):
    rnd, start = random.Random(8), dt.date(2020, 11, 1)

    def after(d, n=1):
        for _ in range(n):
            d = d + dt.timedelta(days=1) if unit == "DAY" else (d.replace(day=28) + dt.timedelta(days=5)).replace(day=1)
        return d

    until = after(start, 30)
    rows, firsts = {}, {}
    for k in range(7):
        firsts[k] = after(start, rnd.randint(0, 12)) if k < 6 else None  # the last key has no spine
        for n in rnd.sample(range(30), rnd.randint(0, 12)):
            rows[k, after(start, n)] = [rnd.choice([None, 5, 7]), rnd.choice([None, 3, -2])]
        if firsts[k]:
            rows.setdefault((k, firsts[k]), [None, None])
    data = [(k, d, *v, firsts[k] if d == firsts[k] else None, f"name{k}") for (k, d), v in rows.items()]
    df = spark.createDataFrame(data, "k int, d date, v int, c int, __start date, s string")
    got = {(r.k, r.d): (r.v, r.c, r["__prior"].c, r["__before"].v if r["__before"] else None, r.s) for r in
           shapes.gap_filled(df, "k", "d", F.lit(until), unit, own=["v"], carried=["c"], same=["s"], before=["v"]).collect()}
    want = {}
    for k, first in firsts.items():
        d = first
        while d and d <= until:
            upto = sum(v[1] or 0 for (j, e), v in rows.items() if j == k and e <= d)
            ahead = sum(v[1] or 0 for (j, e), v in rows.items() if j == k and e < d)
            last = next((e for (j, e) in rows if j == k and after(e) == d), None)
            want[k, d] = (rows.get((k, d), [None])[0], upto, ahead, rows[k, last][0] if last and last >= first else None, f"name{k}")
            d = after(d)
    assert got == want


def test_monthly_peak_mrr_matches_daily_brute_force(spark):
    from types import SimpleNamespace

    from meridian.plans.terminal import monthly_mrr

    rnd = random.Random(4)
    as_of = "2021-06-15"
    asof = dt.date.fromisoformat(as_of)
    prices = {"free": 0.0, "starter": 49.0, "pro": 199.0, "enterprise": 999.0}
    orgs = [(o, dt.datetime(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 400))) for o in range(8)]
    subs = []
    for i in range(90):
        o = 0 if rnd.random() < 0.4 else rnd.randint(1, 7)
        s = dt.datetime(2019, 12, 1) + dt.timedelta(days=rnd.randint(0, 560))
        e = None if rnd.random() < 0.15 else s + dt.timedelta(days=rnd.choice([0, 29, 30, 31, rnd.randint(1, 200)]))
        subs.append((i, o, rnd.choice(list(prices)), "active", s, e))
    plans = spark.createDataFrame([(k, v) for k, v in prices.items()], "plan_id string, monthly_price_usd double")
    b = SimpleNamespace(
        as_of=as_of, plans=plans,
        organizations=spark.createDataFrame(orgs, "organization_id long, created_at timestamp_ntz"),
        sessions=spark.createDataFrame([(dt.datetime(2019, 12, 1),)], "started_at timestamp_ntz"),
        subscriptions=spark.createDataFrame(subs, "subscription_id long, organization_id long, plan_id string, "
                                                  "status string, current_period_start timestamp_ntz, "
                                                  "current_period_end timestamp_ntz"))
    marks = b.organizations.select("organization_id", F.trunc("created_at", "MM").alias("month_start"), F.trunc("created_at", "MM").alias("__start"))
    sparse = monthly_mrr(b).unionByName(marks, allowMissingColumns=True).groupBy("organization_id", "month_start").agg(
        *[F.max(c).alias(c) for c in ("__mrr", "_peak", "__start")])
    full = shapes.gap_filled(sparse, "organization_id", "month_start", F.lit(as_of).cast("date"), "MONTH", own=["_peak"], carried=["__mrr"])
    peak = (F.col("__prior.__mrr") + F.coalesce("_peak", F.lit(0))) / 100.0
    got = {(r.organization_id, r.month_start): r.mrr_usd for r in full.select("organization_id", "month_start", peak.alias("mrr_usd")).collect()}
    want = {}
    for o, created in orgs:
        d = max(created.date(), dt.date(2019, 12, 1))
        while d <= asof:
            v = sum(prices[p] for _, so, p, _, s, e in subs if so == o and prices[p] > 0
                    and s.date() <= d <= min((e.date() if e else asof), asof))
            m = d.replace(day=1)
            if d >= created.date():
                want[(o, m)] = max(want.get((o, m), 0.0), v)
            d += dt.timedelta(days=1)
    assert {k: v for k, v in got.items() if v > 0} == {k: v for k, v in want.items() if v > 0}
