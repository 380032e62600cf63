"""Corpus operators: links under headings, merged queries, read plans, layouts and scores of helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.functions.text import url_host

#: Headings and paper links, in text order.
_MARKS = r"(?m)(^#{1,2}\s+.+$|\[\[?\\?Paper\\?\]?\]\([^)]+\))"


def fixed_url(url: Column) -> Column:
    return (
        F.when(url.startswith("http"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith(":/"), F.concat(F.lit("https"), url)).otherwise(F.concat(F.lit("https://"), url))
    )


def paper_links(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, url, section): the first link to each address, with the heading before it.

    The nearest ## heading counts, or the nearest # heading where no ## comes before.
    Addresses without a host are left out.  Null texts have no links.
    """
    marks = files.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_MARKS), F.lit(0))).alias("pos", "mark"))
    before = Window.partitionBy(key).orderBy("pos")
    said = F.trim(F.regexp_replace("mark", r"^#+\s+", ""))
    heading = lambda sign: F.last(F.when(F.col("mark").rlike(rf"^{sign}\s"), said), ignorenulls=True).over(before)
    named = marks.withColumn("section", F.coalesce(heading("##"), heading("#"), F.lit(""))).filter(~F.col("mark").startswith("#"))
    url = fixed_url(F.trim(F.regexp_extract("mark", r"\(([^)]+)\)", 1)))
    rows = named.select(key, "pos", "section", url.alias("url")).filter(F.coalesce(url_host(F.col("url")), F.lit("")) != "")
    return rows.groupBy("url").agg(F.min(F.struct(key, "pos", "section")).alias("x")).select(f"x.{key}", "url", "x.section")


def merged_queries(rows: DataFrame, key: str, at: str, query: str) -> DataFrame:
    """(key, queries): queries in order, joined by " | "; one that the text so far holds adds nothing."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(at, query))), lambda x: x[query])
    join = lambda acc, q: F.when(acc == "", q).when(acc.contains(q), acc).otherwise(F.concat(acc, F.lit(" | "), q))
    return rows.groupBy(key).agg(F.aggregate(ordered, F.lit(""), join).alias("queries"))


def resolved_request(entry: Column, shared: Column) -> Column:
    """An entry's own range clears the shared ones that are at odds with it; else the shared ones hold.

    Both are struct<lines, head, tail, start, end, number>; lines win over head, head over
    tail, tail over start and end, of which an entry may take one and leave the other shared.
    """
    own = [entry[c].isNotNull() for c in ("lines", "head", "tail")]
    span = entry["start"].isNotNull() | entry["end"].isNotNull()
    any_own = own[0] | own[1] | own[2] | span
    pick = lambda c: F.when(any_own, entry[c]).otherwise(shared[c])
    ends = lambda c: F.when(own[0] | own[1] | own[2], entry[c]).otherwise(F.coalesce(entry[c], shared[c]))
    return F.struct(
        pick("lines").alias("lines"), pick("head").alias("head"), pick("tail").alias("tail"), ends("start").alias("start"), ends("end").alias("end"),
        F.coalesce(entry["number"], shared["number"], F.lit(False)).alias("number"),
    )


def multi_read(lines: DataFrame, requests: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One text per request (req, path, first, last, numbered): its lines in order; null where the path is unknown.

    A path may be asked for more than once, in other ranges each time.
    """
    shown = F.when(F.col("numbered"), F.concat(F.lpad(F.col("line_no").cast("string"), F.length(F.col("total").cast("string")), F.lit(" ")), F.lit("\t"), F.col("line")))
    met = requests.join(lines, "path").filter(F.col("line_no").between(F.col(first), F.col(last)))
    texts = met.groupBy("req", "path").agg(F.array_sort(F.collect_list(F.struct("line_no", shown.otherwise(F.col("line")).alias("line")))).alias("x"))
    texts = texts.select("req", "path", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
    return requests.select("req", "path").join(texts, ["req", "path"], "left")


def layout_gaps(required: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """Required paths that don't exist."""
    return required.select(path).join(existing, path, "left_anti")


def leaks(files: DataFrame, path: str, pattern: str) -> DataFrame:
    """Files of a tree that an agent must not see."""
    return files.filter(F.col(path).rlike(pattern))


def pruned(files: DataFrame, path: str, skip: list[str]) -> DataFrame:
    """Files under no folder of a skipped name; names may hold *."""
    names = "|".join(n.replace(".", r"\.").replace("*", "[^/]*") for n in skip)
    return files.filter(~F.col(path).rlike(f"(^|/)({names})/"))


def coverage_in_order(expected: DataFrame, processed: DataFrame, at: str, key: str) -> DataFrame:
    """One row: complete, whether the processed keys are the expected ones in their order."""
    a = expected.select(F.col(at), F.col(key).alias("x"))
    b = processed.select(F.col(at), F.col(key).alias("y"))
    return a.join(b, at, "full_outer").agg((F.count_if(~F.col("x").eqNullSafe(F.col("y"))) == 0).alias("complete"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal, whether two tables hold the same rows as often."""
    columns = a.columns
    count = lambda t, sign: t.select(*columns, F.lit(sign).alias("n"))
    off = count(a, 1).union(count(b, -1)).groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")
    return off.agg((F.count("*") == 0).alias("equal"))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values win, keys of either table stay."""
    a, b = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("fresh"))
    joined = a.join(b, key, "full_outer")
    return joined.select(key, F.when(F.col("fresh"), F.col("new_value")).otherwise(F.col("old_value")).alias(value))


def task_filter(rows: DataFrame, case: str, path: str, task: str) -> DataFrame:
    """Cases that are the task, begin with it and __, or hold it; if there are none, paths that hold it."""
    name = F.col(case)
    by_case = rows.filter((name == task) | name.startswith(f"{task}__") | name.contains(task))
    return rows.filter(F.col(path).contains(task)) if by_case.isEmpty() else by_case


def natural_key(name: Column, prefix: str) -> list[Column]:
    """Names whose rest behind the prefix is a number go first, by number; others by the rest."""
    rest = F.replace(name, F.lit(prefix), F.lit(""))
    digits = rest.rlike(r"^\d+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, rest).try_cast("bigint"), F.when(~digits, rest)]


def limited(rows: DataFrame, most: int) -> DataFrame:
    """0 is no limit."""
    return rows.limit(most) if most else rows


def helper_score(calls: Column, failures: Column, saved: Column, delta: Column) -> Column:
    """Successful calls, more for saved characters, half if cases got worse."""
    useful = calls * (1 - failures / F.greatest(calls, F.lit(1)))
    return useful * (1 + F.coalesce(saved, F.lit(0)) / 1000) * F.when(F.coalesce(delta, F.lit(0)) >= 0, 1.0).otherwise(0.5)


def dead_helpers(stats: DataFrame, calls: int = 1, cases: int = 1) -> DataFrame:
    return stats.filter((F.coalesce("calls", F.lit(0)) < calls) | (F.coalesce("cases", F.lit(0)) < cases))


def step_flags(steps: DataFrame) -> DataFrame:
    """Adds is_wasted, is_timeout and is_redundant_read to steps (trial_id, i, op_type, verb, rc, output, files).

    Wasted: failed, but not a search without hits (grep, rc 1).  A read is redundant if a
    file of it was read before, or if it is in a run of three or more reads.
    """
    order = Window.partitionBy("trial_id").orderBy("i")
    read = F.col("op_type") == "read"
    seen = F.array_distinct(F.flatten(F.collect_list(F.when(read, F.col("files"))).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    run = F.sum(F.when(read, 0).otherwise(1)).over(order)
    marked = steps.withColumn("_seen", seen).withColumn("_run", run)
    in_run = F.count_if(read).over(Window.partitionBy("trial_id", "_run"))
    out = marked.withColumn("_n", in_run)
    wasted = (F.coalesce("rc", F.lit(0)) != 0) & ~((F.col("verb") == "grep") & (F.col("rc") == 1))
    return (
        out.withColumn("is_wasted", wasted)
        .withColumn("is_timeout", F.coalesce("rc", F.lit(0)).isin(-1, 124) & F.lower(F.coalesce("output", F.lit(""))).contains("timed out"))
        .withColumn("is_redundant_read", read & (F.arrays_overlap("files", "_seen") | (F.col("_n") >= 3)))
        .drop("_seen", "_run", "_n")
    )
