"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

DataFrame operations only.  A document is the sequence of its lines that hold
something other than blanks, and every such line starts a suffix.  Suffixes are ranked
by their first line, then by ``min_run`` lines, then by twice that depth round after
round: the rank of a suffix is paired with the rank of the suffix that lies a depth
further on, and the distinct pairs, sorted over range partitions, give the next ranks.
A suffix whose rank nobody shares, or whose document ends, is settled and leaves; the
rounds go on until all are settled, so the longest repeat is covered.

Suffixes of equal rank at depth d are an interval of the suffix array whose longest
common prefix is d lines or more; its first member in document order is the first
copy.  The later members of all intervals, merged, are the maximal repeated runs of a
document, and those lines are deleted.

Lines are named by two 64-bit hashes with different seeds; from the first ranks on all
is exact.  At 1e13 lines the chance that any two different lines share a name is 1e-12.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import discard, documents, free_name, materialise, row_uid

INK = "[^ \\t\\r\\x0B\\x0C]"
BLANKS = "[ \\t\\r\\x0B\\x0C]+"


def _name(x: Column) -> list[Column]:
    """128 bits that stand for a line or a run of lines."""
    return [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")]


def _first() -> Column:
    """The first member of a node; a null doc_id comes last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid", "pos")).alias("first")


def _later() -> Column:
    return ~(F.col("first.uid").eqNullSafe(F.col("uid")) & (F.col("first.pos") == F.col("pos")))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, pos, h1, h2): lines with ink, pos counting these."""
    inked = F.filter(F.split("text", "\n"), lambda s: s.rlike(INK))
    named = F.transform(inked, lambda s: F.struct(*_name(s)))
    return docs.select("doc_id", "uid", F.posexplode(named).alias("pos", "x")).select("doc_id", "uid", "pos", "x.*")


def _ranked(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(doc_id, uid, pos, rank, later): rows whose keys occur more than once.

    Ranks keep the order of the keys: distinct keys are range-partitioned and sorted, and
    the partition and row number of a key make one long.  The nodes are a written table,
    so both sides of the join are dealt out for it alone and the adaptive skew join may
    split the rows of a frequent line.
    """
    nodes = rows.groupBy(*keys).agg(F.count("*").alias("n"), _first()).filter("n > 1").drop("n")
    nodes = nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    nodes = materialise(nodes.withColumn("rank", F.monotonically_increasing_id()), "nodes")
    shared = materialise(rows.join(nodes, keys).select("doc_id", "uid", "pos", "rank", _later().alias("later")), "suffixes")
    discard(nodes)
    return shared


def _ahead(rows: DataFrame, shift: int, keys: list[str]) -> DataFrame:
    """Suffixes with their rank and the rank ``shift`` lines further on; those without one are settled."""
    in_order = Window.partitionBy("uid", "doc_id").orderBy("pos").rangeBetween(shift, shift)
    paired = rows.withColumn("b", F.max("rank").over(in_order)).filter("b IS NOT NULL")
    return paired.select("doc_id", "uid", "pos", F.col("rank").alias(keys[0]), F.col("b").alias(keys[1]))


def intervals(docs: DataFrame, min_run: int = 3) -> DataFrame:
    """(uid, pos, depth): later members of the intervals of depth min_run, 2 min_run, 4 min_run ... lines."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, depth, found = _ranked(_lines(docs), ["h1", "h2"], parts), 1, []
    while True:
        if depth >= min_run:
            found.append(rows.filter("later").select("uid", "pos", F.lit(depth).alias("depth")))
            if not rows.take(1):
                return functools.reduce(DataFrame.union, found)
        shift = depth if depth >= min_run else min(depth, min_run - depth)
        paired = materialise(_ahead(rows, shift, ["a", "b"]), "pairs")
        if depth < min_run:
            discard(rows)
        rows = _ranked(paired, ["a", "b"], parts)
        discard(paired)
        depth += shift


def short_runs(docs: DataFrame, below: int, min_words: int) -> DataFrame:
    """(uid, pos, depth): later copies of runs of fewer than ``below`` lines that hold min_words words or more."""
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(INK))
    counted = F.transform(lines, lambda s: F.struct(*_name(s), F.size(F.array_remove(F.split(s, BLANKS), "")).alias("words")))
    rows = docs.select("doc_id", "uid", counted.alias("lines"))

    def windows(n: int):
        def window(x, i):
            run = F.slice("lines", i + 1, n)
            words = F.aggregate(run, F.lit(0), lambda a, y: a + y["words"])
            whole = (F.size(run) == n) & (words >= min_words)
            names = F.transform(run, lambda y: F.struct(y["h1"], y["h2"]))
            return F.when(whole, F.struct(i.alias("pos"), F.lit(n).alias("depth"), *_name(names)))

        return F.array_compact(F.transform("lines", window))

    found = rows.select("doc_id", "uid", F.explode(F.concat(*[windows(n) for n in range(1, below)])).alias("x"))
    found = materialise(found.select("doc_id", "uid", "x.*"), "short")
    nodes = materialise(found.groupBy("depth", "h1", "h2").agg(F.count("*").alias("n"), _first()).filter("n > 1").drop("n"), "nodes")
    return found.join(nodes, ["depth", "h1", "h2"]).filter(_later()).select("uid", "pos", "depth")


def maximal_runs(found: DataFrame) -> DataFrame:
    """(uid, start, end): later copies merged where they overlap or touch; end is exclusive."""
    in_order = Window.partitionBy("uid").orderBy("pos", "depth")
    reach = F.max(F.col("pos") + F.col("depth")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("pos") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0)
    marked = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("uid", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("depth")).alias("end")).drop("run")


def rewrite(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_run: int = 3,
    min_words: int | None = None,
    prefix: str = "_",
) -> DataFrame:
    """``docs`` with all its columns; text loses later copies.

    With ``min_words`` later copies of runs of fewer than ``min_run`` lines go too if
    the run holds so many words.  Three columns are added, named by ``prefix`` and
    ``uid``, ``n_lines``, ``n_removed`` with further underscores in front where ``docs``
    has such a column.  Null text stays null and counts as one blank line; repeated rows
    stay and get the same result; an empty table stays empty.
    """
    names = [free_name(docs, f"{prefix}{c}") for c in ("uid", "n_lines", "n_removed")]
    base = documents(docs, id_col, text_col)
    found = intervals(base, min_run)
    if min_words is not None and min_run > 1:
        found = found.union(short_runs(base, min_run, min_words))
    runs = maximal_runs(found).groupBy(F.col("uid").alias("run_uid")).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    # the table's own columns travel in one struct, so that no name can clash
    held = docs.select(F.struct("*").alias("row"), row_uid(docs, id_col, text_col).alias("uid"), docs[text_col].cast("string").alias("text"))
    joined = held.join(runs, F.col("uid") == F.col("run_uid"), "left")
    joined = joined.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    touched = F.col("runs").isNotNull()
    inked = F.array_compact(F.transform("lines", lambda s, i: F.when(s.rlike(INK), i)))
    joined = joined.withColumn("inked", F.when(touched, inked))
    gone = F.flatten(F.transform("runs", lambda r: F.slice("inked", r["start"] + 1, r["end"] - r["start"])))
    joined = joined.withColumn("gone", F.when(touched, gone))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(touched, F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("text"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.col("uid").alias(names[0]),
        F.size("lines").cast("long").alias(names[1]),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(names[2]),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 3) -> DataFrame:
    """Delete later copies of every run of ``min_run`` or more lines.

    Returns doc_id, uid, text (lines left, joined by newlines), n_lines (all lines),
    n_removed.  The first copy is the one with the least (doc_id, uid, position);
    a null doc_id comes last.  Rows with equal id and text count as one document, so
    neither is a copy of the other, and both get the same result.  Blank lines are
    never deleted and never part of a run.  Null text is empty: one blank line.
    Extra columns are ignored.  Tables may be empty.
    """
    base = documents(docs, id_col, text_col).drop("uid")
    return rewrite(base, min_run=min_run, prefix="").select("doc_id", "uid", "text", "n_lines", "n_removed")
