"""Digests of file trees as Merkle trees, and the files that differ between two.

Files are dealt to 16^depth leaves by the first hex digits of the sha256 of their path; a
leaf's digest is that of its files in path order, and a node's that of its children's.  A
leaf holds about n / 16^depth files of a group, so no group is gathered in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.operators.shared import stored


def depth_for(files: int, per_leaf: int = 64) -> int:
    """The depth at which a leaf holds about ``per_leaf`` of so many files."""
    return max(1, math.ceil(math.log(max(files, 1) / per_leaf, 16))) if files > per_leaf else 1


def nodes(files: DataFrame, group: str, path: str, digest: str, depth: int) -> DataFrame:
    """(group, node, digest): all nodes of each group's tree; the root's name is the empty string.

    A file's line is its path, a tab and its digest (a null digest: nothing).  Repeated rows
    count as often as they are there; a null group is a group.
    """
    key = F.coalesce(F.col(path).cast("string"), F.lit(""))
    line = F.concat(key, F.lit("\t"), F.coalesce(F.col(digest), F.lit("")))
    rows = files.select(F.col(group), F.substring(F.sha2(key, 256), 1, depth).alias("node"), key.alias("_key"), line.alias("_line"))
    ordered = F.array_sort(F.collect_list(F.struct("_key", "_line")))
    level = rows.groupBy(group, "node").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n"), 256).alias("digest"))
    out = level
    for d in range(depth - 1, -1, -1):
        child = F.array_sort(F.collect_list(F.struct("node", "digest")))  # 16 children at most
        said = F.array_join(F.transform(child, lambda x: F.concat(x["node"], F.lit("\t"), x["digest"])), "\n")
        level = level.groupBy(group, F.substring("node", 1, d).alias("up")).agg(F.sha2(said, 256).alias("digest"))
        level = level.withColumnRenamed("up", "node")
        out = out.union(level)
    return out


def roots(tree: DataFrame) -> DataFrame:
    return tree.filter("node = ''").drop("node")


def differing_leaves(old: DataFrame, new: DataFrame, group: str, depth: int) -> DataFrame:
    """(group, node): leaves whose digests differ, found from the roots down; only children of differing nodes are compared."""
    a = old.select(F.col(group), "node", F.col("digest").alias("was"))
    b = new.select(F.col(group).alias("_group"), F.col("node").alias("_node"), F.col("digest").alias("now"))
    found = None
    for d in range(depth + 1):
        x, y = a.filter(F.length("node") == d), b.filter(F.length("_node") == d)
        if found is not None:
            up = lambda c: F.substring(c, 1, d - 1)
            above = found.select(F.col(group).alias("_above"), F.col("node").alias("_top"))
            x = x.join(above, F.col(group).eqNullSafe(F.col("_above")) & (up("node") == F.col("_top")), "left_semi")
            y = y.join(above, F.col("_group").eqNullSafe(F.col("_above")) & (up("_node") == F.col("_top")), "left_semi")
        both = x.join(y, F.col(group).eqNullSafe(F.col("_group")) & (F.col("node") == F.col("_node")), "full_outer")
        apart = both.filter(~F.col("was").eqNullSafe(F.col("now")))
        there = F.col("node").isNull()
        found = stored(apart.select(F.when(there, F.col("_group")).otherwise(F.col(group)).alias(group), F.coalesce("node", "_node").alias("node")), "apart")
    return found


def changes(old: DataFrame, new: DataFrame, group: str, path: str, digest: str, depth: int | None = None) -> DataFrame:
    """(group, path, old_digest, new_digest) of files that are new, gone or different; paths are unique in a group.

    Only files of differing leaves are joined.
    """
    if depth is None:
        depth = depth_for(max(old.count(), new.count()))
    leaves = differing_leaves(*(stored(nodes(t, group, path, digest, depth), "nodes") for t in (old, new)), group, depth)
    leaves = leaves.select(F.col(group).alias("_above"), F.col("node").alias("_leaf"))

    def inside(files: DataFrame, g: str, p: str, d: str) -> DataFrame:
        rows = files.select(F.col(group).alias(g), F.col(path).alias(p), F.col(digest).alias(d))
        leaf = F.substring(F.sha2(F.coalesce(F.col(p).cast("string"), F.lit("")), 256), 1, depth)
        return rows.join(leaves, F.col(g).eqNullSafe(F.col("_above")) & (leaf == F.col("_leaf")), "left_semi")

    a, b = inside(old, group, path, "old_digest"), inside(new, "_group", "_path", "new_digest")
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col(path).eqNullSafe(F.col("_path"))
    both = a.withColumn("_old", F.lit(True)).join(b.withColumn("_new", F.lit(True)), same, "full_outer")
    apart = both.filter(F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("old_digest").eqNullSafe(F.col("new_digest")))
    was = F.col("_old").isNotNull()
    return apart.select(
        F.when(was, F.col(group)).otherwise(F.col("_group")).alias(group), F.when(was, F.col(path)).otherwise(F.col("_path")).alias(path), "old_digest", "new_digest"
    )
