"""Global positions, exact quantiles and batches against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.operators import numbering, sequence


def test_numbered_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i) for i in range(3000)]
    rng.shuffle(rows)
    got = numbering.numbered(spark.createDataFrame(rows, "g string, i long").withColumn("_part", F.lit(1)), ["g"], ["i"])
    want = []
    for g in ("hot", "a", "b", None):
        want += [(g, i, n) for n, i in enumerate(sorted(i for h, i in rows if h == g), 1)]
    assert sorted(((r.g, r.i, r.pos) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString().replace("Window [sum", "")
    assert numbering.numbered(spark.createDataFrame([], "g string, i long"), ["g"], ["i"]).collect() == []


def test_round_robin_takes_turns(spark):
    rows = [("g", s, i) for i, s in enumerate("aaaabbc")]
    got = sequence.round_robin(spark.createDataFrame(rows, "g string, s string, i long"), ["g"], "s", "i").orderBy("pos").collect()
    assert [(r.pos, r.s, r.i) for r in got] == [(1, "a", 0), (2, "b", 4), (3, "c", 6), (4, "a", 1), (5, "b", 5), (6, "a", 2), (7, "a", 3)]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_quantiles_narrow_to_the_value(spark, kind, monkeypatch):
    monkeypatch.setattr(numbering, "FEW", 20)
    monkeypatch.setattr(numbering, "BINS", 8)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(3, 4, 3000), np.full(900, 7.0), [0.0, -5.0, 2.0**60]])
    x = np.floor(x) if kind == "long" else x
    data = [(int(v) if kind == "long" else float(v),) for v in x] + [(None,)] * 5
    shares = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    got = numbering.quantiles(spark.createDataFrame(data, f"x {kind}"), "x", shares)
    assert np.allclose(got, np.quantile(x, shares))
    held = sorted(x)
    ranks = [0, 1, 1234, 2000, len(held) - 1]
    found = numbering.kth(spark.createDataFrame(data, f"x {kind}"), "x", ranks)
    assert found == {r: held[r] for r in ranks}
    assert numbering.quantiles(spark.createDataFrame([(None,)], f"x {kind}"), "x", [0.5]) == [None]


def greedy(sizes, budget, most):
    out, batch, used, held = [], 0, 0, 0
    for n in sizes:
        n = n or 0
        if held and (used + n > budget or held == most):
            batch, used, held = batch + 1, 0, 0
        used, held = used + n, held + 1
        out.append(batch)
    return out


def test_packed_is_the_greedy_fold(spark):
    rng = random.Random(8)
    sizes = {g: [rng.choice([0, 1, 3, 10, 40, None]) for _ in range(n)] for g, n in ((1, 700), (2, 1), (3, 9), (None, 30))}
    rows = [(g, i * 2, s) for g, own in sizes.items() for i, s in enumerate(own)]
    rng.shuffle(rows)
    got = numbering.packed(spark.createDataFrame(rows, "g long, i long, s long"), "g", "i", "s", 40, 5).collect()
    found = {g: [r.batch for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] for g in sizes}
    assert found == {g: greedy(own, 40, 5) for g, own in sizes.items()}


def test_a_row_over_the_budget_raises(spark):
    with pytest.raises(Exception, match="over the budget"):
        numbering.packed(spark.createDataFrame([(1, 1, 41)], "g long, i long, s long"), "g", "i", "s", 40, 5).collect()
