"""Plans of the trace queries: the events are read once, however many detectors look at them."""

from __future__ import annotations

import os

from stepwell.plans import encoding, trace_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_signals_share_one_scan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else reuse shows only while running
    try:
        plan = trace_queries.signal_top3(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange hash") <= 8
    assert "Join" not in plan


def test_tasks_grow_in_number_with_the_events(spark, monkeypatch, same_as_sql):
    events = encoding.table(spark, SF_DIR, "events")
    most = max(1, events.count() // 20)
    assert encoding.by_trial(events, most).rdd.getNumPartitions() >= 20
    monkeypatch.setattr(encoding.by_trial, "__defaults__", (most,))
    assert "REPARTITION_BY_NUM" in encoding.steps(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    same_as_sql(trace_queries.signal_top3, trace_queries.ORACLES["signal_top3"])
