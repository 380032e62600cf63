"""Queries of the step features and the rules on runs, over encoded tool calls, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.functions import steps as sf
from stepwell.operators import quality, signals
from stepwell.plans.encoding import TRACE_SQL, table, trace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _steps(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    """trial_id, i and the given columns of the trace."""
    rows = trace(spark, sf_dir)
    return rows.select("trial_id", F.col("i").cast("bigint").alias("i"), *[c.alias(n) for n, c in columns.items()])


KIND_SQL = r"""CASE WHEN v = 'sed' AND regexp_matches(cmd, '\bsed\b[^|]*\s-i\b') THEN 'write' WHEN v IN ('cat', 'tee') AND regexp_matches(cmd, '>\s*>|>\s*\S') THEN 'write'
 WHEN v = 'git' THEN CASE WHEN regexp_extract(cmd, '^\s*git\s+(\w+)', 1) IN ('checkout', 'reset', 'apply', 'add', 'commit', 'stash', 'rm', 'mv', 'init', 'rebase', 'merge') THEN 'write' ELSE 'explore' END
 WHEN v IN ('rm', 'mv', 'cp', 'mkdir', 'touch', 'chmod', 'chown', 'tee', 'ln', 'truncate', 'install') THEN 'write'
 WHEN v IN ('go', 'cargo', 'npm', 'npx', 'pytest', 'make', 'mvn', 'gradle', 'python', 'python3', 'ruby', 'node') THEN 'verify'
 WHEN v IN ('cat', 'head', 'tail', 'sed', 'grep', 'rg', 'find', 'ls', 'nl', 'wc', 'file', 'stat', 'awk', 'less', 'more', 'od') THEN 'read' ELSE 'explore' END"""
KINDS = TRACE_SQL + ", kinds AS (SELECT *, " + KIND_SQL + " AS kind FROM (SELECT *, coalesce(verbs[1], '') AS v FROM trace))"
#: The return code of a content: whole numbers and truth values alone.
RC_SQL = """CASE WHEN json_valid(content) THEN CASE json_type(content, '$.returncode') WHEN 'UBIGINT' THEN CAST(content ->> '$.returncode' AS BIGINT)
 WHEN 'BIGINT' THEN CAST(content ->> '$.returncode' AS BIGINT) WHEN 'BOOLEAN' THEN CASE WHEN content ->> '$.returncode' = 'true' THEN 1 ELSE 0 END END END"""


@query(TRACE_SQL + "SELECT trial_id, i, cmd AS command FROM trace")
def step_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, command=sf.bash_command(F.col("calls")))


@query(TRACE_SQL + "SELECT trial_id, i, coalesce(verbs[1], '') AS verb, array_to_string(verbs, ',') AS verbs FROM trace")
def step_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = sf.bash_command(F.col("calls"))
    return _steps(spark, sf_dir, verb=sf.bash_verb(command), verbs=F.array_join(sf.bash_verbs(command), ","))


@query(KINDS + "SELECT trial_id, i, kind AS op_type, kind <> 'write' AS idempotent FROM kinds")
def step_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = sf.op_type(sf.bash_command(F.col("calls")))
    return _steps(spark, sf_dir, op_type=kind, idempotent=sf.is_idempotent(kind))


@query(TRACE_SQL + f"SELECT trial_id, i, rc AS returncode, coalesce(rc = 0, true) AS success FROM (SELECT *, {RC_SQL} AS rc FROM trace)")
def step_returncodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, returncode=sf.returncode(F.col("contents")), success=sf.step_success(F.col("contents")))


FILES_SQL = r"""list_filter(flatten(list_transform(segments, lambda s: regexp_split_to_array(s, '\s+'))), lambda t: (contains(t, '/') OR regexp_matches(t, '\.\w{1,8}$'))
 AND NOT starts_with(t, '-') AND (NOT contains(t, '=') OR starts_with(t, '/')) AND t NOT IN ('sudo', 'env', 'time', 'nohup', 'exec', 'cd'))"""
BARE_SQL = "list_transform(" + FILES_SQL + ", lambda t: trim(t, '\"'''))"


@query(TRACE_SQL + f"SELECT trial_id, i, array_to_string({BARE_SQL}, ' ') AS files FROM trace")
def step_command_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, files=F.array_join(sf.files_touched(sf.bash_command(F.col("calls"))), " "))


@query(TRACE_SQL + f"SELECT trial_id, i, array_to_string(list_sort(list_distinct(list_concat({BARE_SQL}, CASE WHEN place IS NULL THEN [] ELSE [place] END))), ' ') AS files FROM trace")
def step_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, files=F.array_join(sf.step_files(F.col("calls")), " "))


@query(
    KINDS
    + f"""SELECT trial_id, i, CASE WHEN k % 7 = 0 THEN 'verify' ELSE kind END AS op_type, coalesce(rc = 0, true) AS success,
 CASE WHEN k % 5 = 0 THEN 'fail' WHEN coalesce(rc = 0, true) THEN 'success' ELSE 'fail' END AS op_state FROM (SELECT *, {RC_SQL} AS rc FROM kinds)"""
)
def step_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated fields win over the rules' ones."""
    known = F.struct(
        F.when(F.col("k") % 7 == 0, "verify").alias("op_type"), F.lit(None).cast("boolean").alias("success"),
        F.when(F.col("k") % 5 == 0, "fail").alias("op_state"), F.lit(None).cast("array<string>").alias("files_touched"),
    )
    meta = sf.step_meta(F.col("calls"), F.col("contents"), known)
    return _steps(spark, sf_dir, op_type=meta["op_type"], success=meta["success"], op_state=meta["op_state"])


@query(TRACE_SQL + "SELECT trial_id, i, CAST(CASE WHEN content IS NULL THEN 0 WHEN json_valid(content) THEN n_calls * length(content ->> '$.output') ELSE n_calls * length(content) END AS BIGINT) AS chars FROM trace")
def step_observation_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, chars=sf.observation_chars(F.col("contents")))


@query(
    TRACE_SQL
    + """SELECT trial_id, i, CASE WHEN n_calls = 0 THEN 'action' ELSE array_to_string(list_sort(list_distinct(list_filter([
 CASE WHEN cmd <> '' THEN 'bash:' || coalesce(verbs[1], 'shell') END, CASE WHEN second <> '' THEN 'bash:' || coalesce(second_verbs[1], 'shell') END,
 CASE WHEN place IS NOT NULL THEN 'read-lines' END], lambda x: x IS NOT NULL))), '+') END AS family FROM trace"""
)
def step_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, family=sf.operator_family(F.col("calls")))


SHOWN_SQL = r"""CASE WHEN content IS NULL THEN '' WHEN json_valid(content) THEN concat_ws(chr(10), 'returncode: ' || (content ->> '$.returncode'),
 'output: ' || nullif(content ->> '$.output', ''), 'exception_info: ' || nullif(content ->> '$.exception_info', '')) ELSE content END"""
TEXT_SQL = TRACE_SQL + ", shown AS (SELECT *, CASE WHEN n_calls = 2 THEN one || chr(10) || one ELSE one END AS text FROM (SELECT *, " + SHOWN_SQL + " AS one FROM trace))"


@query(TEXT_SQL + "SELECT trial_id, i, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...<truncated>' ELSE text END AS text FROM shown")
def step_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, text=F.coalesce(sf.clipped_observation(F.col("contents"), 30), F.lit("")))


@query(
    TEXT_SQL
    + r"""SELECT trial_id, i, CASE WHEN len(codes) > 0 THEN CASE WHEN len(list_filter(codes, lambda c: CAST(c AS BIGINT) <> 0)) = 0 THEN 'success' ELSE 'fail' END
 WHEN contains(lower(text), 'permission denied') OR contains(lower(text), 'exception_info:') THEN 'fail' ELSE 'success' END AS op_state
 FROM (SELECT *, regexp_extract_all(text, 'returncode:\s*(-?\d+)', 1) AS codes FROM shown)"""
)
def step_text_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, op_state=sf.text_op_state(F.coalesce(sf.clipped_observation(F.col("contents")), F.lit(""))))


@query(
    TRACE_SQL
    + """SELECT trial_id, CAST(count(*) FILTER (n_calls > 0 OR has_obs OR coalesce(action, '') <> '') AS BIGINT) AS actions,
 CAST(count(*) FILTER (source = 'agent' AND n_calls > 0) AS BIGINT) AS tool_actions, CAST(count(*) FILTER (source = 'agent') AS BIGINT) AS turns FROM trace GROUP BY trial_id"""
)
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = quality.is_action_step(F.col("calls"), F.col("contents").isNotNull(), F.col("action"))
    return trace(spark, sf_dir).groupBy("trial_id").agg(
        F.count_if(acts).alias("actions"),
        F.count_if(quality.is_agent_tool_action(F.col("source"), F.col("calls"))).alias("tool_actions"),
        F.count_if(F.col("source") == "agent").alias("turns"),
    )


ORACLE_SQL = "cmd LIKE '%/tests/dab_query/%'"
EXCUSED_SQL = """(CASE WHEN json_valid(content) THEN json_type(content, '$.returncode') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')
 AND content ->> '$.returncode' NOT IN ('0', 'false') AND trim(content ->> '$.output') = '' ELSE false END)"""


@query(TRACE_SQL + f"SELECT trial_id, i, {ORACLE_SQL} AS oracle, n_calls > 0 AND {EXCUSED_SQL} AS excused, {ORACLE_SQL} AND NOT {EXCUSED_SQL} AS exposed FROM trace")
def oracle_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(
        spark, sf_dir,
        oracle=F.exists("calls", quality.oracle_call),
        excused=F.coalesce(quality.empty_failure(F.get("contents", F.lit(0))), F.lit(False)),
        exposed=F.coalesce(quality.exposed(F.col("calls"), F.col("contents")), F.lit(False)),
    )


@query(TRACE_SQL + f"SELECT trial_id, bool_or({ORACLE_SQL} AND NOT {EXCUSED_SQL}) AS contaminated FROM trace GROUP BY trial_id")
def contaminated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contaminated(trace(spark, sf_dir), "trial_id", "calls", "contents")


@query(TRACE_SQL + f"SELECT trial_id * 100 + i // 10 AS sample_id, bool_or({ORACLE_SQL}) AS contaminated FROM trace GROUP BY 1")
def contaminated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace(spark, sf_dir).withColumn("sample_id", F.col("trial_id") * 100 + F.floor(F.col("i") / 10).cast("bigint"))
    return quality.contaminated(rows, "sample_id", "calls")


@query(
    TRACE_SQL
    + """SELECT trial_id, i // 2 AS pair, bool_and(n_calls > 0 AND has_obs) AS structured, count(place) = count(*) AND count(DISTINCT place) = count(place) AS disjoint
 FROM trace GROUP BY 1, 2 HAVING count(*) = 2"""
)
def merge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring steps: whether both hold calls and results, and touch known files apart."""
    place = F.filter(F.transform("calls", lambda c: F.try_element_at(c["arguments"], F.lit("file_path"))), lambda x: x.isNotNull())
    rows = trace(spark, sf_dir).withColumn("files", place).withColumn("pair", F.floor(F.col("i") / 2).cast("bigint"))
    structured = F.bool_and(quality.mergeable_structure(F.col("calls"), F.col("contents")))
    groups = rows.groupBy("trial_id", "pair").agg(structured.alias("structured"), F.collect_list("files").alias("files"), F.count("*").alias("n"))
    return groups.filter("n = 2").select("trial_id", "pair", "structured", quality.disjoint_files(F.col("files")).alias("disjoint"))


@query(
    TRACE_SQL
    + """SELECT trial_id, min(CASE WHEN k <> 3 THEN 1 ELSE 0 END) = 1 AND min(CASE WHEN k <> 50 THEN 1 ELSE 0 END) = 1 AS annotated FROM trace GROUP BY trial_id"""
)
def annotated_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials whose every step has dependencies (here: k is not 3) and known labels (k is not 50)."""
    rows = trace(spark, sf_dir).groupBy("trial_id").agg(
        F.count("*").cast("int").alias("n"),
        F.map_from_entries(F.collect_list(F.when(F.col("k") != 3, F.struct(F.col("i").cast("string"), F.array(F.lit(0)))))).alias("deps"),
        F.collect_list(F.when(F.col("k") == 50, "other").otherwise("read")).alias("kinds"),
        F.collect_list(F.lit("success")).alias("states"),
    )
    return rows.select("trial_id", quality.is_annotated(F.col("n"), F.col("deps"), F.col("kinds"), F.col("states")).alias("annotated"))


@query(
    r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN (o_orderkey % 7) || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',0' END
 WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE (o_orderkey % 3) || ',0' END END AS deps,
 CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'read' END AS op_type FROM orders"""
)
def parsed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of four shapes: an object, a bare list after prose, other names with repeats, and no list."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.lit('so {"op_type": " Read "}'))
        .when(key % 4 == 1, F.concat(F.lit("first [9], then ["), key % 7, F.lit(", 99, "), key % 7, F.lit("]")))
        .when(key % 4 == 2, F.concat(F.lit('{"deps": ['), key % 3, F.lit(", "), key % 3, F.lit('], "operation_type": "read"}')))
        .otherwise(F.lit("[1, x]"))
    )
    deps, kind = sf.annotation(text, 8)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(deps, ",").alias("deps"), kind.alias("op_type"))


@query(
    TRACE_SQL
    + """, t AS (SELECT trial_id, count(*) FILTER (source = 'agent' AND n_calls > 0) AS n FROM trace GROUP BY trial_id), c AS (SELECT trial_id % 50 AS case_id, count(*) AS n,
 count(*) FILTER (trial_id % 9 = 0 OR t.n = 0) AS bad FROM t GROUP BY 1), e AS (SELECT DISTINCT c_custkey % 60 AS case_id FROM customer)
SELECT sum(n) = sum(n - bad) AND count(*) FILTER (c.case_id IS NULL) + count(*) FILTER (e.case_id IS NULL) + count(*) FILTER (n > 1) = 0 AS valid,
 CAST(sum(n) AS BIGINT) AS trial_count, CAST(sum(n - bad) AS BIGINT) AS valid_trial_count, CAST(count(*) FILTER (c.case_id IS NULL) AS BIGINT) AS missing,
 CAST(count(*) FILTER (e.case_id IS NULL) AS BIGINT) AS unexpected, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicates, CAST(count(*) FILTER (bad > 0) AS BIGINT) AS invalid
FROM c FULL JOIN e ON c.case_id = e.case_id"""
)
def rollout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = F.count_if(quality.is_agent_tool_action(F.col("source"), F.col("calls")))
    trials = trace(spark, sf_dir).groupBy("trial_id").agg(tools.alias("tools"))
    exception = F.when(F.col("trial_id") % 9 == 0, "TimeoutError")
    errors = quality.trial_errors(exception, F.lit(True), F.lit(True), F.col("tools"))
    expected = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 60).alias("case_id"))
    return quality.rollout_report(trials.select((F.col("trial_id") % 50).alias("case_id"), errors.alias("errors")), expected)


@query(
    TRACE_SQL
    + """, n AS (SELECT trial_id AS sample_id, i AS step, k % 3 AS op FROM trace WHERE k % 5 <> 0), p AS (SELECT trial_id AS sample_id, i AS step, k % 2 AS op, k % 10 = 1 AS merged FROM trace WHERE k % 4 <> 0),
 m AS (SELECT sample_id, step FROM p WHERE merged UNION SELECT sample_id, step + 1 FROM p WHERE merged)
SELECT coalesce(n.sample_id, p.sample_id) AS sample_id, coalesce(n.step, p.step) AS step, CASE WHEN p.merged THEN 'merged' WHEN p.step IS NULL AND m.step IS NOT NULL THEN 'covered'
 WHEN p.step IS NULL THEN 'removed' WHEN n.step IS NULL THEN 'added' WHEN n.op = p.op THEN 'kept' ELSE 'replaced' END AS change
FROM n FULL JOIN p ON n.sample_id = p.sample_id AND n.step = p.step LEFT JOIN m ON m.sample_id = coalesce(n.sample_id, p.sample_id) AND m.step = coalesce(n.step, p.step)"""
)
def slice_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice against its shorter one; some steps of the latter merge themselves with the step behind."""
    rows = trace(spark, sf_dir).select(F.col("trial_id").alias("sample_id"), F.col("i").cast("bigint").alias("step"), "k")
    merged = F.when(F.col("k") % 10 == 1, F.array(F.col("step"), F.col("step") + 1))
    negative = rows.filter("k % 5 <> 0").select("sample_id", "step", (F.col("k") % 3).alias("op"))
    positive = rows.filter("k % 4 <> 0").select("sample_id", "step", (F.col("k") % 2).alias("op"), merged.alias("merged_from"))
    return signals.slice_delta(negative, positive)
