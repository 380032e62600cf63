"""Queries over the encoded trajectories, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwell.operators import graph, numbering, sequence, signals
from stepwell.operators.shared import stored
from stepwell.plans.encoding import STEPS_SQL, steps, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


ISLAND = """, runs AS (SELECT trial_id, min(i) AS first_step, max(i) AS last_step, count(*) AS len, sum(obs_chars) AS chars
 FROM (SELECT *, i - row_number() OVER (PARTITION BY trial_id ORDER BY i) AS g FROM kept WHERE {keep}) GROUP BY trial_id, g)
"""
SKIP_SQL = """SELECT trial_id, 'skippable' AS type, 'instruction' AS optimization_target, 'dependency_validated' AS evidence_status,
 CAST(120 + 12 * len + least(chars // 1000, 30) AS BIGINT) AS score, first_step, last_step FROM runs WHERE len >= 2"""
PIVOT_SQL = """SELECT r.trial_id, 'failure_pivot' AS type, 'instruction' AS optimization_target, 'behavioral_diagnostic' AS evidence_status,
 CAST(140 + 20 * len AS BIGINT) AS score, first_step, last_step FROM runs r JOIN steps s ON s.trial_id = r.trial_id AND s.i = last_step + 1
 WHERE len >= 2 AND s.op_state = 'success'"""
MERGE_SQL = """SELECT trial_id, 'mergeable' AS type, 'tools' AS optimization_target, 'dependency_validated' AS evidence_status,
 CAST(150 + 25 * (count(*) - 1) AS BIGINT) AS score, min(i) AS first_step, max(i) AS last_step
 FROM (SELECT k.*, g.signature, (row_number() OVER (PARTITION BY k.trial_id, g.signature, op_type ORDER BY k.i) - 1) // 4 AS chunk
       FROM kept k JOIN (SELECT trial_id, i, list_sort(list(j)) AS signature FROM deps GROUP BY trial_id, i) g USING (trial_id, i)
       WHERE kept AND op_state = 'success')
 GROUP BY trial_id, signature, op_type, chunk HAVING count(*) >= 2"""
LONG_SQL = """SELECT trial_id, 'long_observation' AS type, 'both' AS optimization_target, 'cost_diagnostic' AS evidence_status,
 CAST(80 + least(obs_chars // 1000, 80) AS BIGINT) AS score, i AS first_step, i AS last_step FROM kept WHERE kept AND obs_chars > 4000"""
HOT_SQL = """SELECT trial_id, 'hotspot' AS type, 'tools' AS optimization_target, 'cost_diagnostic' AS evidence_status,
 CAST(70 + 8 * count(*) + least(sum(obs_chars) // 2000, 40) AS BIGINT) AS score, min(i) AS first_step, max(i) AS last_step
 FROM steps GROUP BY trial_id, family HAVING count(*) >= 3 AND sum(obs_chars) >= 2000"""


@query(STEPS_SQL + ISLAND.format(keep="op_state = 'fail'") + PIVOT_SQL)
def failure_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.failure_pivot(steps(spark, sf_dir))


@query(STEPS_SQL + ISLAND.format(keep="NOT kept") + SKIP_SQL)
def islands_skippable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.skippable(signals.kept_steps(steps(spark, sf_dir)))


@query(STEPS_SQL + MERGE_SQL)
def mergeable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.mergeable(signals.kept_steps(steps(spark, sf_dir)))


@query(STEPS_SQL + LONG_SQL)
def long_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.long_observation(signals.kept_steps(steps(spark, sf_dir)))


@query(STEPS_SQL + HOT_SQL)
def hotspot_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.hotspot(steps(spark, sf_dir))


ALL_SQL = (
    STEPS_SQL
    + ISLAND.format(keep="NOT kept")
    + ISLAND.format(keep="op_state = 'fail'").replace("runs AS", "fails AS")
    + ", found AS ("
    + " UNION ALL ".join([SKIP_SQL, MERGE_SQL, PIVOT_SQL.replace("runs r", "fails r"), LONG_SQL, HOT_SQL])
    + ")"
)


@query(ALL_SQL + " SELECT type, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM found GROUP BY type")
def signal_union_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.candidates(steps(spark, sf_dir))
    return found.groupBy("type").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(
    ALL_SQL
    + """, ranked AS (SELECT *, list_position(['skippable','mergeable','failure_pivot','long_observation','hotspot'], type) AS p,
 row_number() OVER (PARTITION BY trial_id, type ORDER BY score DESC, first_step, last_step) = 1 AS best FROM found)
SELECT trial_id, type, score, first_step, last_step, pick FROM (SELECT *, row_number() OVER (PARTITION BY trial_id
 ORDER BY best DESC, CASE WHEN best THEN p END NULLS FIRST, score DESC, p, first_step, last_step) AS pick FROM ranked) WHERE pick <= 3"""
)
def signal_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = signals.select_top(signals.candidates(steps(spark, sf_dir)))
    return top.select("trial_id", "type", "score", "first_step", "last_step", "pick")


@query(STEPS_SQL + "SELECT trial_id, count(*) AS n_kept FROM closure GROUP BY trial_id")
def closure_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(steps(spark, sf_dir)).select("trial_id", F.size("keep").cast("bigint").alias("n_kept"))


@query(STEPS_SQL + "SELECT trial_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS nodes FROM closure GROUP BY trial_id")
def closure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(steps(spark, sf_dir)).select("trial_id", F.array_join("keep", ",").alias("nodes"))


ANCHOR_SQL = """, start AS (SELECT trial_id, arg_max(i, (CASE WHEN op_state <> 'success' THEN 0 WHEN op_type = 'verify' THEN 3
 WHEN op_type = 'write' THEN 2 WHEN op_type = 'read' THEN 1 ELSE 0 END) * 1000000 + i) AS anchor FROM steps GROUP BY trial_id)"""


@query(STEPS_SQL + ANCHOR_SQL + " SELECT trial_id, anchor FROM start")
def anchor_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anchor(steps(spark, sf_dir))


@query(
    STEPS_SQL
    + ANCHOR_SQL
    + """, good AS (SELECT d.* FROM deps d LEFT JOIN steps s ON s.trial_id = d.trial_id AND s.i = d.j
  WHERE d.j > 0 AND NOT (s.op_state = 'fail' AND s.op_type <> 'explore')),
reach AS (SELECT trial_id, anchor AS i FROM start UNION SELECT g.trial_id, g.j FROM reach r JOIN good g ON g.trial_id = r.trial_id AND g.i = r.i)
SELECT trial_id, count(*) + 1 AS n_kept FROM reach GROUP BY trial_id"""
)
def filtered_closure_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    kept = graph.filtered_closure(rows, graph.anchor(rows))
    return kept.select("trial_id", F.size("keep").cast("bigint").alias("n_kept"))


@query(STEPS_SQL + "SELECT trial_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, i ORDER BY j DESC) AS r FROM deps WHERE j > 0) WHERE r <= 2")
def parents_last2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.last_parents(steps(spark, sf_dir)).select("trial_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))


@query(STEPS_SQL + "SELECT trial_id, j AS i, min(i) AS consumer FROM deps WHERE j > 0 GROUP BY trial_id, j")
def consumers_first1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.first_consumer(steps(spark, sf_dir))
    return got.select("trial_id", F.col("i").cast("bigint").alias("i"), F.col("consumer").cast("bigint").alias("consumer"))


@query(
    STEPS_SQL
    + """SELECT trial_id, family, i FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, family, a > 2 AND a <= m - 2 ORDER BY obs_chars DESC, i) AS r
 FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, family ORDER BY i) AS a, count(*) OVER (PARTITION BY trial_id, family) AS m FROM steps))
 WHERE m <= 5 OR NOT (a > 2 AND a <= m - 2) OR r <= 1"""
)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sequence.representatives(steps(spark, sf_dir), ["trial_id", "family"], "i", "obs_chars")
    return got.select("trial_id", "family", F.col("i").cast("bigint").alias("i"))


@query(
    STEPS_SQL
    + """SELECT trial_id, op_type, chunk, count(*) AS n FROM (SELECT trial_id, op_type, (row_number() OVER (PARTITION BY trial_id, op_type ORDER BY i) - 1) // 4 AS chunk
 FROM steps) GROUP BY trial_id, op_type, chunk HAVING count(*) >= 2"""
)
def chunk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sequence.chunked(steps(spark, sf_dir), ["trial_id", "op_type"], "i")
    return got.groupBy("trial_id", "op_type", "chunk").agg(F.count("*").alias("n"))


PHASES = STEPS_SQL + """, r AS (SELECT *, sum(c) OVER (PARTITION BY trial_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(op_type) OVER (PARTITION BY trial_id ORDER BY i) = op_type THEN 0 ELSE 1 END AS c FROM steps)),
runs2 AS (SELECT trial_id, run, op_type, min(i) AS a, max(i) AS b FROM r GROUP BY ALL),
fold AS (SELECT trial_id, run, a, b, op_type, a AS pa, false AS closed, 0 AS pb, '' AS pop FROM runs2 WHERE run = 1
 UNION ALL SELECT f.trial_id, n.run,
  CASE WHEN n.b - n.a + 1 < 3 OR f.b - f.a + 1 < 3 THEN f.a ELSE n.a END, n.b,
  CASE WHEN n.b - n.a + 1 < 3 THEN f.op_type ELSE n.op_type END, f.a,
  NOT (n.b - n.a + 1 < 3 OR f.b - f.a + 1 < 3), f.b, f.op_type
 FROM fold f JOIN runs2 n ON n.trial_id = f.trial_id AND n.run = f.run + 1),
done AS (SELECT trial_id, pa AS a, pb AS b, pop AS op FROM fold WHERE closed
 UNION ALL SELECT trial_id, a, b, op_type FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY run DESC) AS q FROM fold) WHERE q = 1)
"""


@query(PHASES + "SELECT trial_id, CAST(s AS BIGINT) AS first, CAST(least(b, s + 11) AS BIGINT) AS last, op AS op_type FROM (SELECT *, unnest(range(a, b + 1, 12)) AS s FROM done)")
def phase_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.phases(steps(spark, sf_dir), "trial_id", "i", "op_type")


@query(
    PHASES
    + """, part AS (SELECT trial_id, s AS first, least(b, s + 11) AS last, op FROM (SELECT *, unnest(range(a, b + 1, 12)) AS s FROM done)),
scored AS (SELECT p.trial_id, 'phase_fallback' AS type, CASE WHEN op = 'explore' THEN 'instruction' ELSE 'both' END AS optimization_target, 'bounded_context_fallback' AS evidence_status,
 CAST(5 * (last - first + 1) + least(sum(obs_chars) // 1000, 30) AS BIGINT) AS score, first AS first_step, last AS last_step
 FROM part p JOIN steps s ON s.trial_id = p.trial_id AND s.i BETWEEN first AND last WHERE last - first >= 2 GROUP BY p.trial_id, op, first, last)
SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY score DESC, first_step) AS r FROM scored) WHERE r <= 3"""
)
def phase_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.phase_candidates(steps(spark, sf_dir))


@query("SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def prefix_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(before), ">").alias("history"))


@query(r"""SELECT conv_id, CASE WHEN length(t) > 1000 THEN substr(t, 1, 1000) || '...' ELSE t END AS task FROM (SELECT conv_id,
 trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id)""")
def first_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter((F.col("role") == "user") & (F.trim("text") != ""))
    text = F.trim(F.regexp_replace(F.min_by("text", "turn"), r"\s+", " "))
    short = F.when(F.length("t") > 1000, F.concat(F.substring("t", 1, 1000), F.lit("..."))).otherwise(F.col("t"))
    return rows.groupBy("conv_id").agg(text.alias("t")).select("conv_id", short.alias("task"))


@query(STEPS_SQL + "SELECT trial_id, i, row_number() OVER (PARTITION BY i ORDER BY trial_id) AS pos FROM steps")
def step_major_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).select("trial_id", F.col("i").cast("bigint").alias("i"))
    return numbering.numbered(rows, ["i"], ["trial_id"])


@query(
    """SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY t, c_nationkey) AS pos FROM (SELECT *,
 row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS t FROM customer)"""
)
def round_robin_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sequence.round_robin(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_nationkey", "c_custkey")
    return got.select("c_custkey", "c_mktsegment", "pos")


SAMPLE_SQL = """SELECT c_custkey, c_nationkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey
 ORDER BY sha256('stepwell-v1:' || c_custkey), c_custkey) AS turn FROM {rows}) ORDER BY turn, sha256('stepwell-v1:' || c_nationkey), c_nationkey LIMIT {n}"""


@query(SAMPLE_SQL.format(rows="customer", n=64))
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.hash_sample(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", 64).select("c_custkey", "c_nationkey", "turn")


@query(
    "WITH taken AS (" + SAMPLE_SQL.format(rows="customer", n=16) + ") "
    + SAMPLE_SQL.format(rows="(SELECT * FROM customer ANTI JOIN taken USING (c_custkey))", n=64)
)
def hash_sample_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer")
    taken = sequence.hash_sample(cases, "c_custkey", "c_nationkey", 16).select("c_custkey")
    left = cases.join(taken, "c_custkey", "left_anti")
    return sequence.hash_sample(left, "c_custkey", "c_nationkey", 64).select("c_custkey", "c_nationkey", "turn")


@query(
    STEPS_SQL
    + """, packed AS (SELECT trial_id, i, obs_chars, 0 AS batch, obs_chars AS used, 1 AS held FROM steps WHERE i = 1
 UNION ALL SELECT s.trial_id, s.i, s.obs_chars, CASE WHEN used + s.obs_chars > 60000 OR held = 8 THEN batch + 1 ELSE batch END,
  CASE WHEN used + s.obs_chars > 60000 OR held = 8 THEN s.obs_chars ELSE used + s.obs_chars END, CASE WHEN used + s.obs_chars > 60000 OR held = 8 THEN 1 ELSE held + 1 END
 FROM packed p JOIN steps s ON s.trial_id = p.trial_id AND s.i = p.i + 1)
SELECT trial_id, i, obs_chars, CAST(batch AS BIGINT) AS batch FROM packed"""
)
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 steps at most under a budget that often closes them earlier; a step over it is a batch of its own."""
    rows = steps(spark, sf_dir).select("trial_id", F.col("i").cast("bigint").alias("i"), "obs_chars")
    return numbering.packed(rows, "trial_id", "i", "obs_chars", 60_000, 8, alone=True)


READ_SQL = """, reads AS (SELECT trial_id, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY trial_id ORDER BY i) AS g FROM steps
 WHERE op_type = 'read') GROUP BY trial_id, g HAVING count(*) >= 3)"""


@query(STEPS_SQL + READ_SQL + "SELECT count(*) AS n_runs, CAST(sum(len) AS BIGINT) AS n_steps, round(CAST(sum(len) AS DOUBLE) / (SELECT count(*) FROM steps), 6) AS share FROM reads")
def read_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    runs = sequence.islands(rows, "trial_id", "i", F.col("op_type") == "read").filter("len >= 3")
    total = rows.agg(F.count("*").alias("all"))
    summed = runs.agg(F.count("*").alias("n_runs"), F.sum("len").alias("n_steps"))
    return summed.crossJoin(F.broadcast(total)).select(  # one row each
        "n_runs", "n_steps", F.round(F.col("n_steps").cast("double") / F.col("all"), 6).alias("share")
    )


@query(STEPS_SQL + "SELECT trial_id, family, count(*) - 1 AS repeats FROM steps WHERE op_type IN ('read', 'explore') GROUP BY trial_id, family")
def repeat_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).filter(F.col("op_type").isin("read", "explore"))
    return rows.groupBy("trial_id", "family").agg((F.count("*") - 1).alias("repeats"))


@query(STEPS_SQL + "SELECT k % 7 AS returncode, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM steps GROUP BY k % 7")
def rc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = steps(spark, sf_dir).groupBy((F.col("k") % 7).alias("returncode")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()), 6))  # 7 rows


@query(STEPS_SQL + "SELECT family, count(*) AS n, CAST(max(obs_chars) AS BIGINT) AS longest FROM steps WHERE obs_chars > 5000 GROUP BY family")
def long_obs_by_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).filter("obs_chars > 5000")
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.max("obs_chars").alias("longest"))


@query(
    STEPS_SQL
    + """SELECT round(CAST(sum(p) AS DOUBLE) / count(*), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75), 6) AS p75, max(p) AS most
 FROM (SELECT trial_id, max(obs_chars) AS p FROM steps GROUP BY trial_id)"""
)
def peak_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = stored(steps(spark, sf_dir).groupBy("trial_id").agg(F.max("obs_chars").alias("p")), "peaks")
    median, upper = (F.lit(q).cast("double") for q in numbering.quantiles(peaks, "p", [0.5, 0.75]))
    return peaks.agg(
        F.round(F.sum("p").cast("double") / F.count("*"), 6).alias("mean"),
        F.round(F.first(median), 6).alias("median"),
        F.round(F.first(upper), 6).alias("p75"),
        F.max("p").alias("most"),
    )


@query(
    STEPS_SQL
    + """, helpers AS (SELECT unnest(['view', 'click', 'error', 'purchase', 'signup', 'unused']) AS helper)
SELECT helper, count(s.trial_id) AS calls, count(DISTINCT s.trial_id) AS cases FROM helpers LEFT JOIN steps s ON s.family = helper GROUP BY helper"""
)
def helper_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    helpers = spark.createDataFrame([(h,) for h in ("view", "click", "error", "purchase", "signup", "unused")], "helper string")
    rows = steps(spark, sf_dir).groupBy("family").agg(F.count("*").alias("calls"), F.count_distinct("trial_id").alias("cases"))
    joined = rows.join(F.broadcast(helpers), F.col("family") == F.col("helper"), "right")
    return joined.select("helper", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"), F.coalesce("cases", F.lit(0)).cast("bigint").alias("cases"))
