"""Rules on runs: completeness, contamination, set checks, judge verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: arguments that reach for answers or private checks.
ORACLE_PATH = r"(?i)(?:ground[_-]?truth(?:\.csv)?|(?:^|[/\\])app[/\\]dab[/\\]query[/\\]validate\.py(?:$|[^A-Za-z0-9_.-])|(?:^|[/\\])tests[/\\]dab_query(?:[/\\]|$))"


def oracle_call(call: Column) -> Column:
    return F.coalesce(F.to_json(call["arguments"]).rlike(ORACLE_PATH), F.lit(False))


def empty_failure(content: Column) -> Column:
    """A result whose return code is a number other than 0 and whose outputs are blank.

    A return code in quotes is no number and proves nothing; true counts as 1.
    """
    parsed = F.try_parse_json(content)
    raw = F.try_variant_get(parsed, "$.returncode", "variant")
    kind = F.schema_of_variant(raw)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(parsed, "$.returncode", "double") != 0)
    number = number.when(kind == "BOOLEAN", F.try_variant_get(parsed, "$.returncode", "boolean"))
    blank = F.lit(True)
    for field in ("output", "stdout", "output_head"):
        text = F.coalesce(F.try_variant_get(parsed, f"$.{field}", "string"), F.lit(""))
        falsy = text.isin("0", "false") & ~F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")) == "STRING", F.lit(False))
        blank = blank & ((F.regexp_replace(text, r"\s+", "") == "") | falsy)
    return F.coalesce(number & blank, F.lit(False))


def exposed(calls: Column, contents: Column) -> Column:
    """An oracle call whose result of the same index is no empty failure."""
    pairs = F.arrays_zip(calls.alias("call"), contents.alias("content"))
    return F.exists(pairs, lambda x: oracle_call(x["call"]) & ~empty_failure(x["content"]))


def contaminated(steps: DataFrame, group: str, calls: str, contents: str | None = None) -> DataFrame:
    """(group, contaminated): any oracle call in a sample's steps; with ``contents``, any exposure in a run's."""
    hit = F.exists(calls, oracle_call) if contents is None else exposed(F.col(calls), F.col(contents))
    return steps.groupBy(group).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("contaminated"))


def is_agent_tool_action(source: Column, tool_calls: Column) -> Column:
    """Stricter than an action step: the agent's, with a call."""
    return F.coalesce(source == "agent", F.lit(False)) & (F.coalesce(F.size(tool_calls), F.lit(0)) > 0)


def mergeable_structure(tool_calls: Column, results: Column) -> Column:
    """Calls, and an observation that holds a list of results (null: some other shape)."""
    return (F.coalesce(F.size(tool_calls), F.lit(0)) > 0) & results.isNotNull()


def is_annotated(n: Column, deps: Column, kinds: Column, states: Column) -> Column:
    """All of 1 .. n have dependencies, and every step a known kind and state."""
    keyed = F.forall(F.sequence(F.lit(1), n), lambda i: F.map_contains_key(deps, i.cast("string"))) | (n == 0)
    known = F.forall(kinds, lambda k: F.coalesce(k.isin("read", "write", "verify", "explore"), F.lit(False)))
    return F.coalesce(deps.isNotNull() & keyed & known & F.forall(states, lambda s: F.coalesce(s.isin("success", "fail"), F.lit(False))), F.lit(False))


def is_action_step(tool_calls: Column, has_observation: Column, action: Column) -> Column:
    return (F.coalesce(F.size(tool_calls), F.lit(0)) > 0) | has_observation | (F.coalesce(action, F.lit("")) != "")


def disjoint_files(files: Column) -> Column:
    """Every member has files and no file belongs to two members."""
    distinct = F.transform(files, F.array_distinct)
    total = F.aggregate(F.transform(distinct, F.size), F.lit(0), lambda a, n: a + n)
    return F.forall(files, lambda f: F.size(f) > 0) & (F.size(F.array_distinct(F.flatten(distinct))) == total)


def expected_actual(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status): missing, unexpected, duplicate or complete."""
    n = actual.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("wanted", F.lit(True)).join(n, key, "full_outer")
    status = (
        F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("n") > 1, "duplicate").otherwise("complete")
    )
    return both.select(key, status.alias("status"))


def map_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two tables, nulls compared safely."""
    a, b = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    return a.join(b, key, "full_outer").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def verdict(decision: Column, scores: Column, blocking: Column, need: int = 5) -> Column:
    """accept only with all scores between 3 and 4 and nothing blocking; else reject."""
    values = F.map_values(scores)
    good = (F.size(scores) == need) & F.forall(values, lambda s: s.isNotNull() & (s >= 3) & (s <= 4))
    return F.when(F.coalesce((decision == "accept") & good & (F.size(blocking) == 0), F.lit(False)), "accept").otherwise("reject")


def trial_errors(exception: Column, has_result: Column, has_steps: Column, tool_actions: Column) -> Column:
    """Errors of one trial; a reward of zero is none."""
    return F.array_compact(
        F.array(
            F.when(~has_result, F.lit("missing_or_invalid_result")).when(exception.isNotNull(), F.concat(F.lit("trial_exception:"), exception)),
            F.when(~has_steps, F.lit("missing_or_invalid_trajectory")).when(tool_actions == 0, F.lit("no_agent_tool_action")),
        )
    )


def rollout_report(trials: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row: valid, and the numbers of trials, valid trials, and missing, unexpected, duplicate and invalid cases.

    ``trials`` holds case_id and errors, a row a trial.  With ``expected`` (case_id) the
    cases must be these, once each.  No trial at all is not valid.  Which cases they are
    is in `expected_actual` and in the trials' errors, a row each.
    """
    per_case = trials.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("bad"))
    wanted = (expected if expected is not None else trials).select("case_id").distinct().withColumn("wanted", F.lit(True))
    both = per_case.join(wanted, "case_id", "full_outer")
    out = both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("trial_count"),
        F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0)).alias("valid_trial_count"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("wanted").isNull()).alias("unexpected"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.count_if(F.col("bad") > 0).alias("invalid"),
    )
    clean = (F.col("trial_count") > 0) & (F.col("valid_trial_count") == F.col("trial_count"))
    clean = clean & (F.col("missing") + F.col("unexpected") + F.col("duplicates") == 0)
    return out.select(clean.alias("valid"), "*")


def harness_issues(tools: Column) -> Column:
    """What is wrong with the text of a tool list: not a JSON list, no name, no parameter object, names twice."""
    parsed = F.try_parse_json(tools)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    field = lambda x, path: F.try_variant_get(x, path, "string")
    names = F.transform(items, lambda x: F.coalesce(field(x, "$.function.name"), field(x, "$.name"), F.lit("")))
    shape = lambda x, path: F.coalesce(F.schema_of_variant(F.try_variant_get(x, path, "variant")), F.lit(""))
    typed = F.forall(items, lambda x: shape(x, "$.function.parameters").startswith("OBJECT") | shape(x, "$.parameters").startswith("OBJECT"))
    return F.array_compact(
        F.array(
            F.when(items.isNull(), "not_a_list"),
            F.when(F.exists(names, lambda n: n == ""), "missing_name"),
            F.when(~typed, "parameters_not_object"),
            F.when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_names"),
        )
    )


def tool_issues(name: Column, properties: Column, required: Column) -> Column:
    """Issues of one tool definition."""
    unknown = F.array_except(required, properties)
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(name.rlike("^[a-z][a-z0-9-]*$"), F.lit(False)), F.lit("bad_name")),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown_required:"), F.array_join(F.array_sort(unknown), ","))),
        )
    )


def tree_digest(files: DataFrame, group: str, path: str, digest: str) -> DataFrame:
    """One digest per group over its files in path order."""
    line = F.concat(F.col(path), F.lit("\t"), F.col(digest))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path), line.alias("line")))), lambda x: x["line"]), "\n")
    return files.groupBy(group).agg(F.sha2(joined, 256).alias("digest"))
