"""Substring containment between two tables against plain Python."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from stepwell.operators import containment
from stepwell.plans import relational_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def found(spark, texts, items):
    a = spark.createDataFrame(texts, "id long, text string").withColumn("uid", F.lit("x")).withColumn("size", F.lit(1))
    b = spark.createDataFrame(items, "item string, passage string").withColumn("gram", F.lit(2))
    got = containment.containing(a, "id", F.col("text"), b, "item", F.col("passage"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain(texts, items):
    return {(i, j) for i, t in texts if t is not None for j, p in items if p is not None and p in t}


@pytest.mark.parametrize("block", [1 << 20, 37])
def test_random_passages(spark, block, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK", block)
    rng = random.Random(4)
    letters = "aab é中\U0001f600"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 300])))) for i in range(80)]
    texts += [(90, None), (3, texts[3][1]), (91, "x" * 5000 + "needle in hay" + "x" * 5000)]
    items = []
    for k in range(120):
        t = rng.choice(texts)[1] or ""
        at, n = rng.randrange(len(t) + 1), rng.choice([1, 2, 3, 5, 8, 9, 30])
        items.append((f"i{k}", t[at : at + n] if k % 4 else "".join(rng.choice(letters) for _ in range(n))))
    items += [("null", None), ("empty", ""), ("long", "x" * 4000 + "needle in hay"), ("no", "needle  in hay"), ("i1", items[1][1])]
    want = plain(texts, items)
    assert ("long" in {j for _, j in want}) and len(want) > 300
    assert found(spark, texts, items) == want


def test_empty_tables(spark):
    assert found(spark, [], [("a", "b")]) == set()
    assert found(spark, [(1, "b")], []) == set()
    assert found(spark, [(1, "b"), (2, "")], [("e", "")]) == {(1, "e"), (2, "e")}


def test_no_nested_loop(spark):
    for name in ("contamination_docs", "theta_first_match", "fragment_first_match"):
        got = relational_queries.QUERIES[name](spark, SF_DIR)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert got.take(1)


def test_set_except_has_rows(spark):
    assert relational_queries.QUERIES["set_except"](spark, SF_DIR).take(1)


def test_first_matches_are_looked_for_in_parts_and_orders(spark, tmp_path, same_as_sql):
    nations, parts = [(0, "NATION_0"), (1, "ring"), (2, "xyz")], [(5, "old Ring"), (4, "a nail"), (3, "RIND"), (9, None)]
    spark.createDataFrame(nations, "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, "1-URGENT"), (8, "2-HIGH")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    query = relational_queries.theta_first_match
    assert same_as_sql(query, relational_queries.ORACLES["theta_first_match"], str(tmp_path)) == 2
    assert {r.n_nationkey: r.p_partkey for r in query(spark, str(tmp_path)).collect()} == {0: 4, 1: 3}
