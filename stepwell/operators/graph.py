"""Dependency graphs whose edges point to smaller positions, one array fold per trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_deps(deps: Column, i: Column) -> Column:
    """Integers in 0 .. i - 1, first occurrences, 0 appended if absent."""
    fine = F.array_distinct(F.filter(deps, lambda d: d.isNotNull() & (d >= 0) & (d < i)))
    return F.when(F.array_contains(fine, 0), fine).otherwise(F.concat(fine, F.array(F.lit(0))))


def _trials(steps: DataFrame) -> DataFrame:
    return steps.groupBy("trial_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "deps"))).alias("nodes"), F.max("i").alias("n")
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often a lambda within looks at it."""
    return F.transform(F.array(value), body)[0]


def reached(nodes: Column, last: Column, shut: Column | None = None) -> Column:
    """Words of bits, array<bigint>: bit r stands for position last - r, set if ``last`` depends on it.

    ``last`` itself is set; 0 is left out.  Positions in ``shut`` are never reached, so nothing is through
    them (``last`` is, even there).  Nodes are structs of i, deps and more.

    Edges point backwards, so they are folded by target from the last position to the first: when an
    edge comes up, the step that it starts from is settled.  Only the open word is written, finished
    words are appended, so a trial takes time in its steps and edges.  A shut position comes up as an
    edge from nowhere, before the other edges to it.
    """
    last = last.cast("int")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    inside = F.filter(nodes, lambda x: x["i"] <= last)
    edge = lambda to, by: F.struct(to.cast("int").alias("to"), by.cast("int").alias("by"))
    own = lambda x: F.transform(F.filter(F.coalesce(x["deps"], F.array().cast("array<int>")), lambda j: (j > 0) & (j < x["i"])), lambda j: edge(last - j, last - x["i"]))
    found = F.flatten(F.transform(inside, own))
    if shut is not None:
        found = F.concat(found, F.transform(F.filter(shut, lambda j: (j > 0) & (j < last)), lambda j: edge(last - j, F.lit(-1))))

    def step(acc: Column, e: Column) -> Column:
        held = F.size(acc["done"])
        word, source = F.shiftright(e["to"], 6), F.shiftright(e["by"], 6)
        moved = word > held
        base = F.when(moved, none).otherwise(acc["open"])
        seen = F.when(source == word, base).when(source == held, acc["open"]).otherwise(F.get(acc["done"], source))
        hit = (e["by"] >= 0) & (e["to"] != acc["shut"]) & (F.getbit(F.coalesce(seen, none), e["by"].bitwiseAND(63)) == 1)
        bit = F.call_function("shiftleft", one, e["to"].bitwiseAND(63))
        return F.struct(
            F.when(moved, F.concat(acc["done"], F.array(acc["open"]), F.array_repeat(none, word - held - 1))).otherwise(acc["done"]).alias("done"),
            F.when(hit, base.bitwiseOR(bit)).otherwise(base).alias("open"),
            F.when(e["by"] < 0, e["to"]).otherwise(acc["shut"]).alias("shut"),
        )

    start = F.struct(F.array().cast("array<bigint>").alias("done"), one.alias("open"), F.lit(-1).alias("shut"))
    return F.aggregate(F.sort_array(found), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def is_reached(words: Column, last: Column, i: Column) -> Column:
    """Whether `reached` from ``last`` has set position i."""
    r = (last - i).cast("int")
    bit = F.getbit(F.get(words, F.shiftright(r, 6)), r.bitwiseAND(63))
    return (r >= 0) & (F.coalesce(bit, F.lit(0)) == 1)


def _positions(nodes: Column, last: Column, shut: Column | None = None) -> Column:
    """Positions that `reached` sets, in ascending order."""
    some = lambda words: F.filter(F.sequence(F.lit(1), last.cast("int")), lambda i: is_reached(words, last, i))
    return F.when(last < 1, F.array().cast("array<int>")).otherwise(_let(reached(nodes, last, shut), some))


def with_kept(nodes: Column, last: Column) -> Column:
    """Nodes with the field ``kept``: whether ``last`` depends on them."""
    return _let(reached(nodes, last), lambda words: F.transform(nodes, lambda x: x.withField("kept", is_reached(words, last, x["i"]))))


def closure(steps: DataFrame) -> DataFrame:
    """(trial_id, keep): positions the last step depends on."""
    return _trials(steps).select("trial_id", _positions(F.col("nodes"), F.col("n")).alias("keep"))


def anchor(steps: DataFrame) -> DataFrame:
    """(trial_id, anchor): last successful verify, else write, else read, else last step."""
    rank = F.when(F.col("op_state") != "success", 0)
    rank = rank.when(F.col("op_type") == "verify", 3).when(F.col("op_type") == "write", 2).when(F.col("op_type") == "read", 1).otherwise(0)
    key = F.struct(rank.alias("r"), F.col("i").alias("i"))
    return steps.groupBy("trial_id").agg(F.max_by("i", key).cast("bigint").alias("anchor"))


def filtered_closure(steps: DataFrame, start: DataFrame) -> DataFrame:
    """As `closure` from an anchor; failed dependencies are dropped unless they explore."""
    bad = steps.groupBy("trial_id").agg(
        F.collect_list(F.when((F.col("op_state") == "fail") & (F.col("op_type") != "explore"), F.col("i"))).alias("bad")
    )
    joined = _trials(steps).join(bad, "trial_id").join(start, "trial_id")
    reach = F.concat(F.array(F.lit(0)), _positions(F.col("nodes"), F.col("anchor"), F.col("bad")))
    return joined.select("trial_id", reach.alias("keep"))


def edges(steps: DataFrame) -> DataFrame:
    """(trial_id, i, j) with j > 0."""
    return steps.select("trial_id", "i", F.explode("deps").alias("j")).filter("j > 0")


def last_parents(steps: DataFrame, most: int = 2) -> DataFrame:
    """Last ``most`` dependencies of each step."""
    order = Window.partitionBy("trial_id", "i").orderBy(F.desc("j"))
    return edges(steps).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def set_consumer(steps: DataFrame, chosen: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(trial_id, set_id, consumer): the first step behind a whole set of steps that depends on one of them.

    ``chosen`` holds (trial_id, set_id, i); with ``kept`` (trial_id, i) only those may consume.
    """
    last = chosen.groupBy("trial_id", "set_id").agg(F.max("i").alias("last"))
    found = edges(steps)
    if kept is not None:
        found = found.join(kept.select("trial_id", "i"), ["trial_id", "i"], "left_semi")
    met = found.join(chosen.select("trial_id", "set_id", F.col("i").alias("j")), ["trial_id", "j"]).join(last, ["trial_id", "set_id"])
    return met.filter("i > last").groupBy("trial_id", "set_id").agg(F.min("i").alias("consumer"))


def first_consumer(steps: DataFrame) -> DataFrame:
    """(trial_id, i, consumer): the first later step that depends on step i."""
    return edges(steps).groupBy("trial_id", F.col("j").alias("i")).agg(F.min("i").alias("consumer"))
