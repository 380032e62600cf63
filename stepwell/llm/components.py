"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v): neighbours move to the least of their centre's."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    after = materialise(moved.filter("u <> v").distinct(), "edges")
    discard(least)
    return after


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without a link are absent.

    Nulls and self-links are ignored; no edges give no rows.  Every step is a grouping by
    node with partial aggregation and an equi-join with its written table: both sides are
    dealt out for the join alone, so the adaptive skew join may split a node with very
    many links.  Tables of earlier steps are removed.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = materialise(start, "edges")
    if not now.take(1):
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        large = _star(now, True)
        after = _star(large, False)
        discard(large)
        got = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).first()
        discard(now)
        now = after
        if got == mark:
            break
        mark = got
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    tops = now.select(F.col("v").alias("node")).distinct().join(roots, F.col("node") == F.col("u"), "left_anti")
    return roots.select(F.col("u").alias("node"), "root").union(tops.select("node", F.col("node").alias("root")))
