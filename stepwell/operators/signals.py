"""Scored signals: where a trajectory wastes steps.  One candidate schema for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.operators import graph, quality, sequence

# Thresholds and scores.
LONG_CHARS = 4000
HOTSPOT_STEPS, HOTSPOT_CHARS = 3, 2000
MERGE_GROUP = 4
PER_TRIAL = 3
PRIORITY = ["skippable", "mergeable", "failure_pivot", "long_observation", "hotspot", "phase_fallback"]


def _thousands(chars: Column, unit: int, most: int) -> Column:
    return F.least(F.floor(chars / unit), F.lit(most))


def _signal(rows: DataFrame, kind: str, target: str | Column, evidence: str, score: Column, first: Column, last: Column) -> DataFrame:
    return rows.select(
        "trial_id",
        F.lit(kind).alias("type"),
        (F.lit(target) if isinstance(target, str) else target).alias("optimization_target"),
        F.lit(evidence).alias("evidence_status"),
        score.cast("bigint").alias("score"),
        first.cast("bigint").alias("first_step"),
        last.cast("bigint").alias("last_step"),
    )


def kept_steps(steps: DataFrame) -> DataFrame:
    """Steps with ``kept``: whether the last step depends on them.

    A trial's steps are gathered once, folded and laid out again, so the rows stay
    partitioned by trial and every detector works on the same exchange.
    """
    fields = [c for c in steps.columns if c != "trial_id"]
    nodes = F.array_sort(F.collect_list(F.struct("i", *[c for c in fields if c != "i"])))
    trials = steps.groupBy("trial_id").agg(nodes.alias("nodes"))
    marked = graph.with_kept(F.col("nodes"), F.element_at("nodes", -1)["i"])
    return trials.select("trial_id", F.inline(marked)).select("trial_id", *fields, "kept")


def skippable(kept: DataFrame) -> DataFrame:
    runs = sequence.islands(kept, "trial_id", "i", ~F.col("kept"), F.sum("obs_chars").alias("chars")).filter("len >= 2")
    score = 120 + 12 * F.col("len") + _thousands(F.col("chars"), 1000, 30)
    return _signal(runs, "skippable", "instruction", "dependency_validated", score, F.col("first"), F.col("last"))


def mergeable(kept: DataFrame) -> DataFrame:
    """Chunks of up to four successful steps of one kind that depend on the same steps.

    With a column ``structured`` all of a chunk must be so; with ``files`` the writes among
    them must touch known files, no file twice.
    """
    key = ["trial_id", "signature", "op_type"]
    rows = kept.filter("kept AND op_state = 'success'").withColumn("signature", F.array_join(F.array_sort("deps"), ","))
    sums = [F.count("*").alias("len"), F.min("i").alias("first"), F.max("i").alias("last")]
    if "structured" in kept.columns:
        sums.append(F.bool_and("structured").alias("structured"))
    if "files" in kept.columns:
        sums.append(F.collect_list("files").alias("files"))
    groups = sequence.chunked(rows, key, "i", MERGE_GROUP).groupBy(*key, "chunk").agg(*sums)
    if "structured" in kept.columns:
        groups = groups.filter("structured")
    if "files" in kept.columns:
        groups = groups.filter((F.col("op_type") != "write") | quality.disjoint_files(F.col("files")))
    return _signal(groups, "mergeable", "tools", "dependency_validated", 150 + 25 * (F.col("len") - 1), F.col("first"), F.col("last"))


def failure_pivot(steps: DataFrame) -> DataFrame:
    """Runs of two or more failures that a success follows."""
    ahead = F.lead("op_state").over(Window.partitionBy("trial_id").orderBy("i"))
    marked = steps.withColumn("ahead", ahead)
    follows = F.max_by("ahead", "i").alias("ahead")
    runs = sequence.islands(marked, "trial_id", "i", F.col("op_state") == "fail", follows).filter("len >= 2 AND ahead = 'success'")
    return _signal(runs, "failure_pivot", "instruction", "behavioral_diagnostic", 140 + 20 * F.col("len"), F.col("first"), F.col("last"))


def long_observation(kept: DataFrame) -> DataFrame:
    rows = kept.filter(F.col("kept") & (F.col("obs_chars") > LONG_CHARS))
    return _signal(rows, "long_observation", "both", "cost_diagnostic", 80 + _thousands(F.col("obs_chars"), 1000, 80), F.col("i"), F.col("i"))


def hotspot(steps: DataFrame) -> DataFrame:
    groups = steps.groupBy("trial_id", "family").agg(
        F.count("*").alias("n"), F.sum("obs_chars").alias("chars"), F.min("i").alias("first"), F.max("i").alias("last")
    ).filter((F.col("n") >= HOTSPOT_STEPS) & (F.col("chars") >= HOTSPOT_CHARS))
    score = 70 + 8 * F.col("n") + _thousands(F.col("chars"), 2000, 40)
    return _signal(groups, "hotspot", "tools", "cost_diagnostic", score, F.col("first"), F.col("last"))


def phase_candidates(steps: DataFrame) -> DataFrame:
    """The three best phases of 3 to 12 steps of each trial."""
    parts = sequence.phases(steps, "trial_id", "i", "op_type", "obs_chars").withColumn("len", F.col("last") - F.col("first") + 1).filter("len >= 3")
    target = F.when(F.col("op_type") == "explore", "instruction").otherwise("both")
    score = 5 * F.col("len") + _thousands(F.col("size"), 1000, 30)
    rows = _signal(parts, "phase_fallback", target, "bounded_context_fallback", score, F.col("first"), F.col("last"))
    order = Window.partitionBy("trial_id").orderBy(F.desc("score"), "first_step")
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r <= 3").drop("_r")


def candidates(steps: DataFrame) -> DataFrame:
    """Candidates of all kinds; phases only of trials that have no other."""
    kept = kept_steps(steps)
    found = phase_candidates(kept)
    for part in (skippable(kept), mergeable(kept), failure_pivot(kept), long_observation(kept), hotspot(kept)):
        found = found.unionByName(part)
    other = F.max(F.col("type") != "phase_fallback").over(Window.partitionBy("trial_id"))
    return found.withColumn("_other", other).filter((F.col("type") != "phase_fallback") | ~F.col("_other")).drop("_other")


def select_top(found: DataFrame, most: int = PER_TRIAL) -> DataFrame:
    """The best of each type in priority order, then the rest by score; ties go by position."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("type"))
    inside = Window.partitionBy("trial_id", "type").orderBy(F.desc("score"), "first_step", "last_step")
    marked = found.withColumn("_p", rank).withColumn("_best", F.row_number().over(inside) == 1)
    key = [F.desc("_best"), F.when(F.col("_best"), F.col("_p")), F.desc("score"), "_p", "first_step", "last_step"]
    pick = F.row_number().over(Window.partitionBy("trial_id").orderBy(*key)).cast("bigint")
    return marked.withColumn("pick", pick).filter(F.col("pick") <= most).drop("_p", "_best")


def slice_delta(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """(sample_id, step, change): both slices (sample_id, step, op) aligned by step.

    Steps of ``positive`` with ``merged_from`` are merged; the steps they merge that it no
    longer holds are covered, and so not removed.
    """
    n = negative.select("sample_id", "step", F.col("op").alias("n_op"), F.lit(True).alias("in_n"))
    p = positive.select("sample_id", "step", F.col("op").alias("p_op"), F.lit(True).alias("in_p"), F.coalesce(F.size("merged_from") > 0, F.lit(False)).alias("merged"))
    covered = positive.select("sample_id", F.explode("merged_from").alias("step")).distinct().withColumn("covered", F.lit(True))
    change = (
        F.when(F.col("merged"), "merged").when(F.col("in_p").isNull() & F.col("covered").isNotNull(), "covered")
        .when(F.col("in_p").isNull(), "removed").when(F.col("in_n").isNull(), "added")
        .when(F.col("n_op").eqNullSafe(F.col("p_op")), "kept").otherwise("replaced")
    )
    both = n.join(p, ["sample_id", "step"], "full_outer").join(covered, ["sample_id", "step"], "left")
    return both.select("sample_id", "step", change.alias("change"))


def trajectory_slice(steps: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen steps (trial_id, i) of trajectories, once each, with their place for display."""
    return steps.join(chosen.select("trial_id", "i").distinct(), ["trial_id", "i"]).withColumn("display_index", F.col("i"))


def merge_steps(members: DataFrame, group: list[str]) -> DataFrame:
    """One step per group: calls and results in order, messages that say something on lines of their own."""
    parts = F.collect_list(F.struct("i", "calls", "contents", F.trim(F.coalesce("message", F.lit(""))).alias("message"), "deps"))
    ordered = F.array_sort(parts, lambda a, b: (a["i"] - b["i"]).cast("int"))
    held = members.groupBy(*group).agg(ordered.alias("m"))
    spoken = F.filter("m", lambda x: x["message"] != "")
    return held.select(
        *group,
        F.flatten(F.transform("m", lambda x: x["calls"])).alias("calls"),
        F.flatten(F.transform("m", lambda x: F.coalesce(x["contents"], F.array().cast("array<string>")))).alias("contents"),
        F.array_join(F.transform(spoken, lambda x: x["message"]), "\n").alias("message"),
        F.transform("m", lambda x: x["i"]).alias("merged_from"),
        F.get("m", F.lit(0))["deps"].alias("shared_deps"),
    )
