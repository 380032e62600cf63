"""Ordered operators: islands, phases, samples.  One shuffle by the group key each, but for those of `numbering`."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.operators import numbering
from stepwell.operators.shared import forget, stored


def islands(rows: DataFrame, group: str, at: str, keep: Column, *more: Column) -> DataFrame:
    """Maximal runs of consecutive positions that satisfy ``keep``: first, last, len and further aggregates."""
    order = Window.partitionBy(group).orderBy(at)
    kept = rows.filter(keep).withColumn("_g", F.col(at) - F.row_number().over(order))
    return kept.groupBy(group, "_g").agg(
        F.min(at).cast("bigint").alias("first"), F.max(at).cast("bigint").alias("last"), F.count("*").alias("len"), *more
    ).drop("_g")


def representatives(rows: DataFrame, group: list[str], at: str, size: str, most: int = 5) -> DataFrame:
    """All rows of small groups; else the first two, the last two and the largest between."""
    whole = Window.partitionBy(*group)
    marked = rows.withColumn("_a", F.row_number().over(whole.orderBy(at))).withColumn("_n", F.count("*").over(whole))
    middle = (F.col("_a") > 2) & (F.col("_a") <= F.col("_n") - 2)
    rank = F.row_number().over(Window.partitionBy(*group, middle).orderBy(F.desc(size), at))
    marked = marked.withColumn("_r", rank)
    return marked.filter((F.col("_n") <= most) | ~middle | (F.col("_r") <= most - 4)).drop("_a", "_n", "_r")


def chunked(rows: DataFrame, group: list[str], at: str, size: int = 4, least: int = 2) -> DataFrame:
    """Rows of each group cut into chunks of ``size``; chunks of fewer than ``least`` go."""
    number = F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(at)) - 1) / size).cast("bigint")
    cut = rows.withColumn("chunk", number)
    n = F.count("*").over(Window.partitionBy(*group, "chunk"))
    return cut.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def phases(rows: DataFrame, group: str, at: str, kind: str, size: str | None = None, least: int = 3, most: int = 12) -> DataFrame:
    """Runs of one kind, short ones merged from left to right, long ones split: first, last, op_type.

    A run of fewer than ``least`` rows joins the phase before it; a phase shorter than
    that takes in the run behind it and its kind.  The merge depends on what was merged before, so it
    is a fold over the array of a group's runs.  ``size``: a column to sum up, as ``size``.
    """
    order = Window.partitionBy(group).orderBy(at)
    change = F.when(F.lag(kind).over(order) == F.col(kind), 0).otherwise(1)
    values = F.lit(0) if size is None else F.col(size)
    runs = (
        rows.withColumn("_c", change)
        .withColumn("_r", F.sum("_c").over(order))
        .groupBy(group, "_r", kind)
        .agg(F.min(at).cast("bigint").alias("a"), F.max(at).cast("bigint").alias("b"), F.collect_list(F.struct(F.col(at).alias("i"), values.cast("bigint").alias("v"))).alias("v"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("a", "b", F.col(kind).alias("op"), "v")))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        joined = lambda op: F.concat(rest, F.array(F.struct(last["a"].alias("a"), x["b"].alias("b"), op.alias("op"))))
        own = F.struct(x["a"].alias("a"), x["b"].alias("b"), x["op"].alias("op"))
        short = x["b"] - x["a"] + 1 < least
        before_short = last["b"] - last["a"] + 1 < least
        return F.when(F.size(acc) == 0, F.array(own)).when(short, joined(last["op"])).when(before_short, joined(x["op"])).otherwise(F.concat(acc, F.array(own)))

    empty = F.array().cast("array<struct<a:bigint,b:bigint,op:string>>")
    held = runs.groupBy(group).agg(ordered.alias("runs"))
    sizes = F.flatten(F.transform("runs", lambda r: F.transform(F.array_sort(r["v"]), lambda x: x["v"])))
    start = F.transform("runs", lambda r: r["a"])[0]
    folded = held.select(group, sizes.alias("sizes"), start.alias("start"), F.explode(F.aggregate("runs", empty, merge)).alias("p"))
    parts = folded.select(group, "sizes", "start", "p", F.explode(F.sequence(F.col("p.a"), F.col("p.b"), F.lit(most).cast("bigint"))).alias("first"))
    parts = parts.withColumn("last", F.least(F.col("p.b"), F.col("first") + most - 1))
    out = [group, "first", "last", F.col("p.op").alias("op_type")]
    if size is None:
        return parts.select(*out)
    inside = F.slice("sizes", (F.col("first") - F.col("start") + 1).cast("int"), (F.col("last") - F.col("first") + 1).cast("int"))
    return parts.select(*out, F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"))


def round_robin(rows: DataFrame, group: list[str], sub: str, at: str) -> DataFrame:
    """Position ``pos`` within each group: one row of every sub-group in turn."""
    turns = numbering.numbered(rows, [*group, sub], [at], "_t")
    return numbering.numbered(turns, group, ["_t", sub]).drop("_t")


def hash_sample(cases: DataFrame, case: str, group: str, limit: int, salt: str = "stepwell-v1:") -> DataFrame:
    """``limit`` cases, spread over groups, the same ones on every run.

    Cases of a group and the groups themselves go by (sha2(salt + id), id); the sample
    takes one case of every group in turn.
    """
    key = lambda c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key(case), case))
    picked = cases.withColumn("turn", turn.cast("bigint")).filter(F.col("turn") <= limit)
    return picked.withColumn("_h", key(group)).orderBy("turn", "_h", group).limit(limit).drop("_h")


pack_batches = numbering.packed


def latest(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The row of each key with the greatest ``at``."""
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value))


def first_wins(rows: DataFrame, key: str, at: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(at)
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def _least_two(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the first and the second place of their key, as _first and _second; a null key has none."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_at").alias("_first"))
    marked = rows.join(first, key, "left")
    second = marked.filter(F.col("_at") > F.col("_first")).groupBy(key).agg(F.min("_at").alias("_second"))
    return marked.join(second, key, "left")


def _chained(links: DataFrame) -> DataFrame:
    """(at, to, odd) with each row's own predecessor -> the same with the row at the chain's root.

    A round joins the unfinished pointers with all pointers of that length, so chains of n
    rows take log2(n) rounds.  Pointers that have arrived are set aside.
    """
    links = stored(links, "links")
    ends, jumps = [], links
    while links.take(1):
        ahead = jumps.select(F.col("at").alias("_via"), F.col("to").alias("_on"), F.col("odd").alias("_also"))
        met = stored(links.join(ahead, F.col("to") == F.col("_via"), "left"), "jumped")
        forget(links)
        ends.append(stored(met.filter("_via IS NULL").select("at", "to", "odd"), "ends"))
        links = stored(met.filter("_via IS NOT NULL").select("at", F.col("_on").alias("to"), (F.col("odd") != F.col("_also")).alias("odd")), "links")
        forget(met)
        jumps = functools.reduce(DataFrame.union, ends, links)
    return functools.reduce(DataFrame.union, ends, links)


def first_matching(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (_at, _a, _b) that share no key with a kept row before them, and the rounds taken.

    In a round, a row that is the first undecided one of both its keys is kept.  A row with exactly one
    undecided row before it that shares a key is kept if that row is not: these rows make chains, and
    pointer doubling gives each its distance to the chain's root.  Where the root is kept, rows
    at an even distance are kept too.  Rows that share a key with a kept row go, the others wait for the
    next round.  A chain of any length takes one round; a further round is only needed behind rows that
    several undecided rows come before.  (In general such an order can't be evaluated in
    parallel: it is as hard as any circuit.)  Each key's group adds its least two places only.
    """
    undecided = stored(rows.select("_at", "_a", "_b"), "undecided")
    kept: list[DataFrame] = []
    while undecided.take(1):
        of_a = _least_two(undecided, "_a").withColumnsRenamed({"_first": "_first_a", "_second": "_second_a"})
        both = _least_two(of_a, "_b")

        def before(first: str, second: str) -> Column:
            """Undecided rows of the key before this one: 0, 1, or 2 for more."""
            at = F.col("_at")
            return F.when(at <= F.coalesce(F.col(first), at), F.lit(0)).when(at == F.col(second), F.lit(1)).otherwise(F.lit(2))

        n_a, n_b = before("_first_a", "_second_a"), before("_first", "_second")
        marked = both.withColumn("_n_a", n_a).withColumn("_n_b", n_b)
        one_a, one_b = F.when(F.col("_n_a") == 1, F.col("_first_a")), F.when(F.col("_n_b") == 1, F.col("_first"))
        marked = marked.withColumn("_to", F.coalesce(one_a, one_b))
        single = (F.greatest("_n_a", "_n_b") == 1) & ((F.least("_n_a", "_n_b") == 0) | (F.col("_first_a") == F.col("_first")))
        root = F.greatest("_n_a", "_n_b") == 0
        marked = stored(marked.select("_at", "_a", "_b", "_to", root.alias("_root"), single.alias("_single")), "marked")
        roots = marked.filter("_root")
        ends = _chained(marked.filter("_single").select(F.col("_at").alias("at"), F.col("_to").alias("to"), F.lit(True).alias("odd")))
        even = ends.filter("NOT odd").join(roots.select(F.col("_at").alias("to")), "to", "left_semi").select(F.col("at").alias("_at"))
        now = roots.select("_at", "_a", "_b").union(marked.join(even, "_at", "left_semi").select("_at", "_a", "_b"))
        now = stored(now, "kept")
        kept.append(now)
        left = undecided.join(now.select("_b"), "_b", "left_anti")
        left = stored(left.join(now.filter("_a IS NOT NULL").select("_a"), "_a", "left_anti").select("_at", "_a", "_b"), "undecided")
        for done in (undecided, marked, ends):
            forget(done)
        undecided = left
    return functools.reduce(DataFrame.union, kept, undecided), len(kept)


def two_key_dedupe(rows: DataFrame, at: str, key_a: str, key_b: str, fill: str, source: str) -> DataFrame:
    """In-order dedupe by two keys: a row goes if a kept row before it has one of its keys.

    Only kept rows register keys.  An empty key_a is none; an empty key_b is a key like
    any other.  A row with the key_a of a kept row before it is merged into that row: it
    fills an empty ``fill``, and ``sources`` unites the values of ``source``.  ``at`` is
    unique and not null.

    The fold is solved by joins over the whole table (`first_matching`), so no group of rows
    is gathered in one place, and chains of keys take a logarithmic number of joins.
    """
    a, b = F.nullif(F.col(key_a), F.lit("")), F.coalesce(F.col(key_b), F.lit(""))
    base = rows.withColumn("_a", a).withColumn("_b", b)
    kept, _ = first_matching(base.select(F.col(at).alias("_at"), "_a", "_b"))
    kept = kept.select(F.col("_at").alias("_base"), F.col("_a").alias("_base_a"))
    heads = base.join(kept, F.col(at) == F.col("_base")).drop("_base_a")
    later = kept.filter("_base_a IS NOT NULL").join(base, F.col("_base_a") == F.col("_a")).filter(F.col(at) >= F.col("_base"))
    merged = later.groupBy("_base").agg(
        F.min_by(fill, F.when(F.col(fill) != "", F.col(at))).alias("_fill"), F.array_sort(F.collect_set(source)).alias("_sources")
    )
    own = F.array_compact(F.array(F.col(source)))
    joined = heads.join(merged, "_base", "left").withColumn("sources", F.coalesce("_sources", own))
    return joined.withColumn(fill, F.coalesce("_fill", fill)).select(*rows.columns, "sources")
