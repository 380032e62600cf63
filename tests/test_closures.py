"""Closures as words of bits, against a walk over the edges, on short trials and on a very long one."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from stepwell.operators import graph, signals

SCHEMA = "trial_id long, i int, deps array<int>, op_state string, op_type string"


def walk(deps, start, shut=frozenset()):
    seen, todo = {start}, [start]
    while todo:
        for j in deps.get(todo.pop(), []):
            if j > 0 and j not in seen and j not in shut:
                seen.add(j)
                todo.append(j)
    return seen


def trial(rng, name, n):
    rows = []
    for i in range(1, n + 1):
        deps = sorted({rng.randrange(max(0, i - 70), i) for _ in range(rng.randrange(3))} | {0})
        rows.append((name, i, deps, rng.choice(["success", "fail"]), rng.choice(["read", "write", "verify", "explore"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_closures(spark, seed):
    rng = random.Random(seed)
    trials = {t: trial(rng, t, n) for t, n in enumerate([1, 2, 63, 64, 65, 66, 127, 128, 129, 130, 300, 700])}
    df = spark.createDataFrame([r for rows in trials.values() for r in rows], SCHEMA)
    got = {r.trial_id: r.keep for r in graph.closure(df).collect()}
    start = {r.trial_id: r.anchor for r in graph.anchor(df).collect()}
    filtered = {r.trial_id: r.keep for r in graph.filtered_closure(df, graph.anchor(df)).collect()}
    kept = {}
    for r in signals.kept_steps(df).filter("kept").select("trial_id", "i").collect():
        kept.setdefault(r.trial_id, set()).add(r.i)
    for t, rows in trials.items():
        deps = {r[1]: r[2] for r in rows}
        want = walk(deps, len(rows))
        assert got[t] == sorted(want)
        assert kept[t] == want
        shut = {r[1] for r in rows if r[3] == "fail" and r[4] != "explore"}
        assert filtered[t] == [0, *sorted(walk(deps, start[t], shut))]


def test_closure_of_gaps(spark):
    """Words without a step between far steps; deps null, empty, to 0 and forward."""
    rows = [(1, 1, None, "fail", "read"), (1, 2, [0], "success", "read"), (1, 500, [2, 0, 900], "success", "read"), (1, 900, [500], "success", "verify")]
    rows += [(2, 1, [], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.trial_id: r.keep for r in graph.closure(df).collect()}
    assert got == {1: [2, 500, 900], 2: [1]}
    assert graph.closure(df.limit(0)).collect() == []


def test_a_trial_of_100000_steps(spark):
    n = 100_000
    chain = spark.range(1, n + 1).select(
        F.lit(1).cast("bigint").alias("trial_id"),
        F.col("id").cast("int").alias("i"),
        F.when(F.col("id") % 3 == 0, F.array(F.col("id") - 3, F.lit(0))).otherwise(F.array(F.col("id") - 1)).cast("array<int>").alias("deps"),
        F.lit("success").alias("op_state"),
        F.lit("verify").alias("op_type"),
    )
    begun = time.monotonic()
    got = graph.closure(chain).select(F.size("keep").alias("n"), F.get("keep", 0).alias("first")).first()
    assert (got.n, got.first) == (n // 3 + 1, 3)  # 100000, 99999, 99996, ... 3
    assert signals.kept_steps(chain).filter("kept").count() == n // 3 + 1
    assert time.monotonic() - begun < 60
