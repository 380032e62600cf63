"""The events table as trajectories: one deterministic encoding, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KIND = {"view": "read", "purchase": "write", "signup": "verify"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events of a task, on the average.  Each detector of signals reads its trials' steps once more.
TASK_EVENTS = 200_000


def by_trial(events: DataFrame, most: int = TASK_EVENTS) -> DataFrame:
    """Events dealt by user, to more tasks where the session's number would give each more than ``most``."""
    parts = -(-events.count() // most)
    if parts <= int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return events
    return events.repartition(parts, "user_id")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, i, n, k, op_state, op_type, family, obs_chars, deps."""
    events = by_trial(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", "props"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.lit("explore")
    for event, op in KIND.items():
        kind = F.when(F.col("event_type") == event, op).otherwise(kind)
    rows = events.select(
        F.col("user_id").alias("trial_id"),
        F.row_number().over(order).alias("i"),
        F.count("*").over(Window.partitionBy("user_id")).cast("int").alias("n"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("event_type") == "error", "fail").otherwise("success").alias("op_state"),
        kind.alias("op_type"),
        F.col("event_type").alias("family"),
        F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("obs_chars"),
    )
    back = F.col("i") - 1 - F.col("k") % 5
    half = F.floor(F.col("i") / 2).cast("int")
    deps = F.array_compact(
        F.array(F.when(back >= 1, back), F.when((F.col("k") % 3 == 0) & (half >= 1) & (half < F.col("i")), half), F.lit(0))
    )
    return rows.withColumn("deps", F.array_distinct(deps))


#: CTEs steps, deps (edges, 0 included), closure (kept steps) and kept, to put before a SELECT.
STEPS_SQL = """
WITH RECURSIVE steps AS MATERIALIZED (
  SELECT user_id AS trial_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS op_state,
         CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'verify' ELSE 'explore' END AS op_type,
         event_type AS family, CAST(floor(value * 100 + 0.5) AS BIGINT) AS obs_chars
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
deps AS MATERIALIZED (
  SELECT trial_id, i, i - 1 - k % 5 AS j FROM steps WHERE i - 1 - k % 5 >= 1
  UNION SELECT trial_id, i, i // 2 FROM steps WHERE k % 3 = 0 AND i // 2 >= 1
  UNION SELECT trial_id, i, 0 FROM steps),
closure AS (
  SELECT trial_id, max(i) AS i FROM steps GROUP BY trial_id
  UNION SELECT d.trial_id, d.j FROM closure c JOIN deps d ON d.trial_id = c.trial_id AND d.i = c.i WHERE d.j > 0),
kept AS (SELECT s.*, c.i IS NOT NULL AS kept FROM steps s LEFT JOIN closure c USING (trial_id, i))
"""

# Fixed values of the encoding: commands by k // 4 % 12, result contents by k // 4 % 6.
COMMANDS = [
    "cat src/a.py",
    "sed -i s/a/b/ src/a.py",
    "cd app && git commit -m y",
    "git cherry-pick a1",
    "cat log.txt 2>/dev/null",
    "FOO=1 sudo /usr/bin/grep x lib/f.c",
    "pytest tests/t.py -q",
    "ls -la | wc -l",
    "git add x.py",
    "rm -rf build/out",
    "python3 run.py --f=a.b",
    'echo hi; cat "d/e.txt"',
]
ORACLE_COMMAND = "cat /repo/tests/dab_query/validate.py"
CONTENTS = [
    '{"returncode": 0, "output": "ok"}',
    '{"returncode": 1, "output": ""}',
    '{"returncode": true, "output": "yes"}',
    "plain text returncode: 2",
    '{"returncode": 1.5, "output": " "}',
    '{"returncode": "1", "output": "", "exception_info": "Permission denied"}',
]


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, i, k, source, message, action, calls, contents (null: no observation)."""
    rows = steps(spark, sf_dir).select("trial_id", "i", "k")
    k = F.col("k")

    def pick(values: list[str]):
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(k / 4) % len(values) + 1).cast("int"))

    command = F.when(k % 25 == 7, F.lit(ORACLE_COMMAND)).otherwise(pick(COMMANDS))
    place = F.concat(F.lit("src/f"), (k % 5).cast("string"), F.lit(".py"))
    call = lambda name, key, value: F.struct(F.lit(name).alias("function_name"), F.create_map(F.lit(key), value).alias("arguments"))
    bash, read = call("bash", "command", command), call("read-lines", "file_path", place)
    none = F.array().cast("array<struct<function_name:string,arguments:map<string,string>>>")
    calls = (
        F.when((F.col("i") == 1) | (k % 10 == 9), none)
        .when(k % 4 == 0, F.array(bash, read))
        .when(k % 4 == 1, F.array(bash))
        .when(k % 4 == 2, F.array(read))
        .otherwise(F.array(bash, call("bash", "command", F.concat(F.lit("ls docs/"), (k % 3).cast("string")))))
    )
    source = F.when(F.col("i") == 1, "user").when(k % 11 == 0, "system").otherwise("agent")
    out = rows.select("*", calls.alias("calls"), source.alias("source"), F.when(k % 20 == 9, "note").alias("action"))
    contents = F.when(F.size("calls") > 0, F.transform("calls", lambda c: pick(CONTENTS))).when(k % 30 == 29, F.array())
    message = F.concat(F.lit(" step  "), F.col("i").cast("string"), F.lit(" "))
    return out.select("trial_id", "i", "k", "source", message.alias("message"), "action", "calls", contents.alias("contents"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SKIP = "NOT ((contains(t, '=') AND NOT starts_with(t, '-')) OR t IN ('sudo', 'env', 'time', 'nohup', 'exec'))"
#: Of a command: its segments, a segment's head, and its verb.
_SEGMENTS = r"list_filter(list_transform(regexp_split_to_array({c}, '&&|\|\||[|;]'), lambda s: trim(s)), lambda s: s <> '')"
_VERBS = (
    "list_filter(list_transform(list_transform(" + _SEGMENTS + r", lambda s: coalesce(list_filter(regexp_split_to_array(s, '\s+'), lambda t: t <> '' AND "
    + _SKIP + ")[1], '')), lambda h: CASE WHEN h = 'cd' THEN '' ELSE lower(regexp_extract(h, '([^/]*)$', 1)) END), lambda v: v <> '')"
)
#: CTEs up to trace (trial_id, i, k, source, action, cmd, second, place, n_calls, content, has_obs) and verbs of cmd.
TRACE_SQL = STEPS_SQL + f""", trace0 AS (SELECT trial_id, i, k, CASE WHEN i = 1 THEN 'user' WHEN k % 11 = 0 THEN 'system' ELSE 'agent' END AS source,
 CASE WHEN k % 20 = 9 THEN 'note' END AS action, i > 1 AND k % 10 <> 9 AS called,
 CASE WHEN k % 25 = 7 THEN '{ORACLE_COMMAND}' ELSE {_sql_list(COMMANDS)}[(k // 4) % 12 + 1] END AS full_cmd,
 'src/f' || (k % 5) || '.py' AS f, {_sql_list(CONTENTS)}[(k // 4) % 6 + 1] AS c0 FROM steps),
trace1 AS (SELECT trial_id, i, k, source, action, CASE WHEN called AND k % 4 <> 2 THEN full_cmd ELSE '' END AS cmd,
 CASE WHEN called AND k % 4 = 3 THEN 'ls docs/' || (k % 3) ELSE '' END AS second, CASE WHEN called AND k % 4 IN (0, 2) THEN f END AS place,
 CASE WHEN NOT called THEN 0 WHEN k % 4 IN (0, 3) THEN 2 ELSE 1 END AS n_calls, CASE WHEN called THEN c0 END AS content,
 called OR k % 30 = 29 AS has_obs FROM trace0),
trace AS (SELECT *, {_VERBS.format(c='cmd')} AS verbs, {_VERBS.format(c='second')} AS second_verbs, {_SEGMENTS.format(c='cmd')} AS segments FROM trace1)
"""
