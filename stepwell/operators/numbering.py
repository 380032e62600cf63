"""Positions, quantiles and batches in a global order, without one task per group.

Rows are range-partitioned by group and order, numbered where they lie, and the counts of
earlier partitions are added: a group of any size is spread over partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.operators.shared import forget, stored


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with their place, from 1, in the order of their group; nulls come first.

    Ties are numbered in any order, so ``order`` should decide.  Names that begin with
    ``_at_`` are the function's own.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    held = stored(dealt.withColumn("_at_part", F.spark_partition_id()).withColumn("_at_row", F.monotonically_increasing_id()), "numbered")
    sizes = held.groupBy(*group, "_at_part").agg(F.count("*").alias("_at_n"), F.min("_at_row").alias("_at_first"))
    before = Window.partitionBy(*group).orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition at most
    starts = sizes.withColumn("_at_before", F.coalesce(F.sum("_at_n").over(before), F.lit(0)))
    starts = starts.select(*[F.col(g).alias(f"_at_{g}") for g in group], F.col("_at_part").alias("_at_of"), "_at_first", "_at_before")
    same = F.col("_at_part") == F.col("_at_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_at_{g}"))
    place = F.col("_at_before") + F.col("_at_row") - F.col("_at_first") + 1
    return held.join(starts, same).select(*rows.columns, place.cast("bigint").alias(name))


#: Bins of a pass, and rows that are sorted when no more are left between the bounds.
BINS, FEW = 1024, 10_000


def kth(values: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """rank (from 0) -> the value at it, nulls left out; each pass narrows the bounds to one bin.

    A pass gathers a count, a minimum and a maximum of each bin.  The bounds are values of the table, so
    they close in until one value or few rows are left; integers are compared exactly while
    their range is under 63 bits.
    """
    x = values.select(F.col(column).alias("x")).filter("x IS NOT NULL")
    whole = dict(x.dtypes)["x"] in ("tinyint", "smallint", "int", "bigint")
    got = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    out: dict[int, float] = {}
    todo = [(got.lo, got.hi, 0, got.n, [r for r in sorted(set(ranks)) if 0 <= r < got.n])]
    while todo:
        lo, hi, below, n, wanted = todo.pop()
        if not wanted:
            continue
        if lo == hi:
            out.update(dict.fromkeys(wanted, lo))
            continue
        inside = x.filter((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi)))
        if n <= FEW:
            held = sorted(r.x for r in inside.collect())
            out.update({r: held[r - below] for r in wanted})
            continue
        if whole:
            at = F.expr(f"(x - {lo}L) div {max(1, (hi - lo) // BINS)}L")
        else:
            at = F.floor((F.col("x") / 2 - lo / 2) / ((hi / 2 - lo / 2) / BINS))
        bins = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        for r in sorted(bins.collect(), key=lambda r: r.bin):
            own = [k for k in wanted if below <= k < below + r.c]
            todo.append((r.a, r.b, below, r.c, own))
            below += r.c
    return out


def quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, straight lines between neighbours; None where there is no value."""
    n = values.filter(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found = kth(values, column, [f(p) for p in places for f in (math.floor, math.ceil)])
    low, high = ([found[f(p)] for p in places] for f in (math.floor, math.ceil))
    return [a + (b - a) * (p - math.floor(p)) for a, b, p in zip(low, high, places)]


def packed(rows: DataFrame, group: str, at: str, size: str, budget: int, most: int, alone: bool = False) -> DataFrame:
    """Greedy batches of consecutive rows under a size budget, as ``batch`` from 0; batches never cross a group.

    A batch that begins at a row ends where the sizes of the next ``most`` rows say, so every
    row has a successor.  The starts are found by doubling from the first row: a round
    joins the starts so far with jumps of twice the length, so a group with s batches takes
    log2(s) rounds.  A row over the budget raises an error, or is a batch of its own where
    ``alone`` says so; a null size counts as none.
    """
    order = Window.partitionBy(group).orderBy(at)
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    fits = n if alone else F.when(n <= budget, n).otherwise(F.raise_error(F.concat(F.lit("a row over the budget: "), n)))

    def take(acc: Column, x: Column) -> Column:
        more = acc["open"] & ((acc["used"] + x <= budget) | (acc["held"] == 0))
        return F.struct((acc["used"] + x).alias("used"), F.when(more, acc["held"] + 1).otherwise(acc["held"]).alias("held"), more.alias("open"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("held"), F.lit(True).alias("open"))
    ahead = F.collect_list(fits).over(order.rowsBetween(0, most - 1))
    base = rows.withColumn("_at_i", F.row_number().over(order).cast("bigint")).withColumn("_at_next", F.aggregate(ahead, start, take)["held"])
    base = stored(base, "packing")
    jumps = stored(base.select(F.col(group).alias("_at_g"), "_at_i", (F.col("_at_i") + F.col("_at_next")).alias("_at_to")), "jumps")
    starts = stored(jumps.filter("_at_i = 1").select("_at_g", "_at_i"), "starts")
    def at_row(df: DataFrame, group: str, i: str, *more: Column) -> DataFrame:
        return df.select(F.col(group).alias("_at_h"), F.col(i).alias("_at_j"), *more)

    here = F.col("_at_g").eqNullSafe(F.col("_at_h")) & (F.col("_at_i") == F.col("_at_j"))
    while True:
        landed = jumps.join(at_row(starts, "_at_g", "_at_i"), here).select("_at_g", F.col("_at_to").alias("_at_i"))
        landed = stored(landed.join(at_row(base, group, "_at_i"), here, "left_semi"), "landed")  # not behind the last row
        if not landed.take(1):
            break
        starts = stored(starts.union(landed), "starts")
        twice = jumps.join(at_row(jumps, "_at_g", "_at_to", F.col("_at_i").alias("_at_from")), here)
        twice = stored(twice.select("_at_g", F.col("_at_from").alias("_at_i"), "_at_to"), "jumps")
        forget(jumps)
        jumps = twice
    marks = at_row(starts, "_at_g", "_at_i", F.lit(1).alias("_at_start"))
    marked = base.join(marks, F.col(group).eqNullSafe(F.col("_at_h")) & (F.col("_at_i") == F.col("_at_j")), "left")
    batch = F.sum(F.coalesce("_at_start", F.lit(0))).over(Window.partitionBy(group).orderBy("_at_i")) - 1
    return marked.withColumn("batch", batch.cast("bigint")).select(*rows.columns, "batch")
