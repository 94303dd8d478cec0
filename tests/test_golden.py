"""Golden fixtures: billing leak, task-queue thresholds, trial-risk reason ladder."""

import datetime as dt

from pyspark.sql import functions as F

from meridian.plans.finance import usage_billing_export
from meridian.plans.growth import signal_thresholds, task_queue, trial_risk


def ts(s):
    return dt.datetime.fromisoformat(s)


def d(s):
    return dt.date.fromisoformat(s)


def test_billing_export_pre_downgrade_overage(spark):
    usage = spark.createDataFrame(
        [("ur_1", "org_1", "sub_2", d("2026-02-01"), d("2026-02-28"), 7, 35.0, 7000, 700, 0)],
        "usage_record_id string, organization_id string, subscription_id string, period_start date, period_end date, "
        "sessions_count int, session_minutes double, bytes_downloaded long, bytes_uploaded long, proxy_requests int")
    plans = spark.createDataFrame([("plan_starter", "starter", 4), ("plan_free", "free", 2)],
                                  "plan_id string, plan_name string, sessions_limit_monthly int")
    subs = spark.createDataFrame(
        [("sub_1", "org_1", "plan_starter", "canceled", ts("2026-02-01 00:00:00"), ts("2026-02-14 23:59:59"),
          ts("2026-02-01 00:00:00")),
         ("sub_2", "org_1", "plan_free", "active", ts("2026-02-15 00:00:00"), ts("2026-03-14 23:59:59"),
          ts("2026-02-15 00:00:00"))],
        "subscription_id string, organization_id string, plan_id string, status string, "
        "current_period_start timestamp_ntz, current_period_end timestamp_ntz, created_at timestamp_ntz")
    days = [2, 3, 4, 10, 11, 12, 20]
    sessions = spark.createDataFrame([(f"s{i}", "org_1", ts(f"2026-02-{x:02d} 10:00:00")) for i, x in enumerate(days)],
                                     "session_id string, organization_id string, created_at timestamp_ntz")
    orgs = spark.createDataFrame([("org_1", "Leak Labs", "billing@leaklabs.example")],
                                 "organization_id string, organization_name string, billing_email string")
    r = usage_billing_export(usage, orgs, subs, plans, sessions).collect()
    assert len(r) == 1
    row = r[0]
    assert row.ledger_sessions_count == 7
    assert row.corrected_entitled_sessions == 3.0
    assert row.corrected_overage_sessions == 4.0
    assert row.current_plan_sessions_limit == 2
    assert row.naive_snapshot_sessions_count == 1
    assert row.naive_overage_sessions == 0
    assert row.overage_leakage_delta == 4.0


def _signals(spark, scores):
    now = ts("2026-03-01 00:00:00")
    rows = [(f"sig{i}", f"org{i}", f"Org {i}", "composite_risk", float(s), now, now + dt.timedelta(hours=24))
            for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "signal_id string, organization_id string, organization_name string, "
                                       "reason_code string, signal_score double, triggered_at timestamp_ntz, "
                                       "expires_at timestamp_ntz")


def test_task_queue_thresholds(spark):
    q = task_queue(_signals(spark, [0.95, 0.82, 0.79]), signal_thresholds(spark))
    got = {r.signal_score: r.priority for r in q.collect()}
    assert got == {0.95: "urgent", 0.82: "high"}


def test_task_queue_threshold_boundary(spark):
    q = task_queue(_signals(spark, [0.80, 0.805, 0.799]), signal_thresholds(spark))
    got = {r.signal_score: r.priority for r in q.collect()}
    assert got == {0.80: "high", 0.805: "high"}


def test_trial_risk_reason_ladder(spark):
    as_of = "2026-03-01"
    subs = spark.createDataFrame(
        [(f"sub{o}", o, ts("2026-03-10 00:00:00"), ts("2026-02-20 00:00:00"), True, "trialing") for o in (1, 2, 3)],
        "subscription_id string, organization_id long, trial_ends_at timestamp_ntz, created_at timestamp_ntz, "
        "is_in_trial boolean, status string")
    orgs = spark.createDataFrame([(o, f"Org {o}", "active") for o in (1, 2, 3)],
                                 "organization_id long, organization_name string, organization_status string")
    sess = [(2, d("2026-02-27"), False, 1), (2, d("2026-02-28"), False, 0),
            (3, d("2026-02-26"), True, 0), (3, d("2026-02-27"), False, 2), (3, d("2026-02-28"), False, 1)]
    sessions = spark.createDataFrame(sess, "organization_id long, session_date date, is_successful boolean, error_count int")
    r = {row.organization_id: row for row in trial_risk(subs, orgs, sessions, as_of).collect()}
    assert r[1].reason_code == "no_recent_usage"
    assert r[2].reason_code == "no_successful_runs"
    assert r[3].reason_code == "low_success_rate"
    # 9 days remaining -> urgency 0.4; org1: 0.5*1.0 + 0.3*0.7 + 0.2*0.4
    assert r[1].signal_score == 0.79
    assert r[3].successful_runs_7d == 1 and r[3].total_runs_7d == 3
    assert all(0.0 <= x.signal_score <= 1.0 for x in r.values())
