"""Queries over files, streams and trees that Spark writes from the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.operators import merkle, reads, search
from stepwell.operators.shared import shared_path
from stepwell.plans.encoding import table
from stepwell.sources.jsonl import checkpoint_files
from stepwell.sources.versions import Versions
from stepwell.streaming import annotation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    """WITH e AS (SELECT user_id % 16 AS file_no, event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
 row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS line_no FROM events)
SELECT file_no, user_id AS step, sha256(event_type) AS input_hash, max(line_no) AS line_no, arg_max(event_id, line_no) AS event_id
FROM e WHERE k % 7 <> 0 AND k % 5 <> 0 GROUP BY file_no, user_id, sha256(event_type)"""
)
def jsonl_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checkpoint files of JSON lines, some torn and some of another version; the last valid record wins."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf_dir, "events").withColumn("k", k).withColumn("file_no", F.col("user_id") % 16)
    record = F.to_json(
        F.struct(
            F.when(F.col("k") % 5 == 0, "v1").otherwise("v2").alias("schema_version"),
            F.lit("fp").alias("annotator_fingerprint"),
            F.col("user_id").alias("step"),
            F.sha2("event_type", 256).alias("input_hash"),
            "event_id",
        )
    )
    torn = F.expr("substring(record, 1, length(record) - 5)")
    lines = rows.withColumn("record", record).withColumn("value", F.when(F.col("k") % 7 == 0, torn).otherwise(F.col("record")))
    path = shared_path(spark, "checkpoints")
    lines.repartition("file_no").sortWithinPartitions("file_no", "event_id").select("file_no", "value").write.partitionBy("file_no").text(path)
    found = checkpoint_files(spark, path, "v2", "fp")
    return found.select(
        F.regexp_extract("file", "file_no=([0-9]+)", 1).cast("bigint").alias("file_no"),
        "step",
        "input_hash",
        "line_no",
        F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"),
    )


@query(
    """WITH seen AS (SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
versions AS (SELECT *, 'a1' AS fingerprint FROM seen UNION ALL SELECT *, 'a2' FROM seen WHERE event_type = 'signup')
SELECT user_id, sha256(event_type || ':' || k) AS input_hash, fingerprint, upper(event_type) || '/' || fingerprint AS label FROM versions"""
)
def incremental_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over halves of the events, then a run after one annotator changed: all that was annotated, once each."""
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.sha2(F.concat_ws(":", "event_type", k), 256).alias("input_hash"), F.lit("a1").alias("fingerprint"), (F.col("event_id") % 2).alias("half")
    )
    again = rows.filter("event_type = 'signup'").withColumn("fingerprint", F.lit("a2"))
    # the last delivery repeats all steps; only those of the changed annotator are new
    deliveries = [rows.filter("half = 0"), rows.filter("half = 1"), rows.filter("event_type <> 'signup'").union(again)]
    source, results, state = (shared_path(spark, label) for label in ("inputs", "annotations", "state"))
    schema = "user_id long, event_type string, input_hash string, fingerprint string"
    label = F.concat_ws("/", F.upper("event_type"), "fingerprint").alias("label")
    for delivery in deliveries:
        delivery.drop("half").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        annotate = lambda new: new.select("user_id", "input_hash", "fingerprint", label)
        annotation.annotate_once(stream, ["user_id", "input_hash", "fingerprint"], annotate, results, state).awaitTermination()
    return annotation.annotated(spark, results, "user_id long, input_hash string, fingerprint string, label string")


DEPTH = 3
LEVELS = "".join(
    f", l{d} AS (SELECT source, substr(node, 1, {d}) AS node, sha256(string_agg(node || chr(9) || digest, chr(10) ORDER BY node)) AS digest FROM l{d + 1} GROUP BY source, substr(node, 1, {d}))"
    for d in range(DEPTH - 1, -1, -1)
)


@query(
    f"""WITH l{DEPTH} AS (SELECT source, substr(sha256(CAST(doc_id AS VARCHAR)), 1, {DEPTH}) AS node,
 sha256(string_agg(doc_id || chr(9) || coalesce(sha256(text), ''), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents GROUP BY 1, 2){LEVELS}
SELECT source, digest FROM l0"""
)
def merkle_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root digests of the sources' trees."""
    files = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return merkle.roots(merkle.nodes(files, "source", "doc_id", "sha", DEPTH))


@query(
    """WITH b AS (SELECT source, doc_id, sha256(text || CASE WHEN n_chars % 97 = 0 THEN '.' ELSE '' END) AS sha FROM documents WHERE n_chars % 89 <> 1),
a AS (SELECT source, doc_id, sha256(text) AS sha FROM documents WHERE n_chars % 83 <> 2)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id, a.sha AS old_digest, b.sha AS new_digest
FROM a FULL JOIN b ON a.source = b.source AND a.doc_id = b.doc_id WHERE a.sha IS DISTINCT FROM b.sha"""
)
def merkle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a later version adds, drops or changes, found by descent."""
    docs = table(spark, sf_dir, "documents")
    later = F.concat("text", F.when(F.col("n_chars") % 97 == 0, ".").otherwise(""))
    new = docs.filter("n_chars % 89 <> 1").select("source", "doc_id", F.sha2(later, 256).alias("sha"))
    old = docs.filter("n_chars % 83 <> 2").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return merkle.changes(old, new, "source", "doc_id", "sha")


@query(
    r"""WITH files AS (SELECT 'd' || doc_id % 20 || '/' || doc_id % 7 || '/' || doc_id || '.md' AS path, string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)) AS l FROM documents),
reads AS (SELECT user_id AS request, event_id AS entry, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
entries AS (SELECT *, CASE WHEN k % 50 = 49 THEN NULL WHEN k % 5 IN (0, 1) THEN 'd' || k % 20 || '/' || k % 7 || '/' || k || '.md' WHEN k % 5 = 2 THEN 'd' || k % 20 || '/?/' || k || '*.md'
 WHEN k % 5 = 3 THEN 'd[!2-9]/[0-3]/' || k || '[05].md' ELSE '*/*/' || k || '.md' END AS spec,
 CASE WHEN k % 5 = 2 THEN 'd' || k % 20 || '/[0-9]/' || k || '[0-9]*[.]md' WHEN k % 5 = 3 THEN 'd[01]/[0-3]/' || k || '[05][.]md' WHEN k % 5 = 4 THEN '[^/]+/[^/]+/' || k || '[.]md' END AS regex FROM reads),
found AS (SELECT s.spec, f.path FROM (SELECT DISTINCT spec, regex FROM entries WHERE regex IS NOT NULL AND spec IS NOT NULL) s JOIN files f ON regexp_full_match(f.path, s.regex)),
blocks AS (SELECT e.*, coalesce(g.path, CASE WHEN regex IS NULL THEN e.spec END) AS path FROM entries e LEFT JOIN found g ON g.spec = e.spec),
lines AS (SELECT b.*, f.l IS NOT NULL AS there, list_transform(f.l, lambda x, i: CASE WHEN i < len(f.l) THEN x || chr(10) ELSE x END) AS l,
 CASE WHEN f.l[-1] = '' THEN len(f.l) - 1 ELSE len(f.l) END AS total, count(*) OVER (PARTITION BY request) > 1 AS several FROM blocks b LEFT JOIN files f ON f.path = b.path),
cut AS (SELECT *, CASE k % 3 WHEN 0 THEN l[1:k % 5] WHEN 1 THEN l[2:4] ELSE l[1:50] END AS c, CASE k % 3 WHEN 1 THEN 2 ELSE 1 END AS n FROM lines),
bodies AS (SELECT *, array_to_string(CASE WHEN k % 2 = 1 THEN list_transform(c[1:greatest(total - n + 1, 0)], lambda x, i: lpad(CAST(n + i - 1 AS VARCHAR), greatest(length(CAST(total AS VARCHAR)), length(CAST(n + i - 1 AS VARCHAR)))::INTEGER, ' ') || chr(9) || x) ELSE c END, '') AS body FROM cut),
texts AS (SELECT request, entry, path, CASE WHEN path IS NULL THEN '=== ' || coalesce(spec, 'None') || ' ===' || chr(10) || '<skipped: invalid path or no glob matches>'
 WHEN NOT there THEN '=== ' || path || ' ===' || chr(10) || 'file not found: ' || path
 ELSE CASE WHEN several THEN '=== ' || path || ' ===' || chr(10) ELSE '' END || CASE WHEN regexp_matches(body, '[^\s]') THEN body ELSE '(empty file)' END END AS block, path IS NULL OR NOT there AS failed FROM bodies),
joined AS (SELECT request, string_agg(block, chr(10) || chr(10) ORDER BY entry, path) AS output, max(CAST(failed AS INTEGER)) AS rc, count(*) AS n_blocks FROM texts GROUP BY request)
SELECT request, CASE WHEN length(output) > 3000 THEN substr(output, 1, 3000) || chr(10) || '... (output truncated from ' || length(output) || ' to 3000 chars)' ELSE output END AS output, rc, n_blocks FROM joined"""
)
def glob_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as reads of documents by path or glob, each with a range: one answer a user, with headers and return code."""
    docs, k = table(spark, sf_dir, "documents"), F.get_json_object("props", "$.k").cast("bigint")
    path = F.concat(F.lit("d"), F.col("doc_id") % 20, F.lit("/"), F.col("doc_id") % 7, F.lit("/"), F.col("doc_id"), F.lit(".md"))
    files = docs.select(path.alias("path"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")).alias("text"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("entry"), k.alias("k"))
    k = F.col("k")
    spec = (
        F.when(k % 50 == 49, None)
        .when((k % 5).isin(0, 1), F.concat(F.lit("d"), k % 20, F.lit("/"), k % 7, F.lit("/"), k, F.lit(".md")))
        .when(k % 5 == 2, F.concat(F.lit("d"), k % 20, F.lit("/?/"), k, F.lit("*.md")))
        .when(k % 5 == 3, F.concat(F.lit("d[!2-9]/[0-3]/"), k, F.lit("[05].md")))
        .otherwise(F.concat(F.lit("*/*/"), k, F.lit(".md")))
    )
    entries = rows.withColumns(
        {"spec": spec, "head": F.when(k % 3 == 0, (k % 5).cast("int")), "lines": F.when(k % 3 == 1, "2-4"), "number": k % 2 == 1}
    )
    return reads.read_answers(entries, files)


@query(
    """WITH a AS (SELECT source || '/' || doc_id AS path, source, text AS content FROM documents),
b AS (SELECT source || '/' || doc_id AS path, source, text || CASE WHEN n_chars % 97 = 0 THEN '.' ELSE '' END AS content FROM documents WHERE n_chars % 89 <> 1),
promoted AS (SELECT path, content FROM a WHERE right(source, 1) NOT IN ('1', '3', '5') UNION ALL SELECT path, content FROM b WHERE right(source, 1) IN ('1', '3', '5')),
versions AS (SELECT 0 AS place, path, content FROM a UNION ALL SELECT 1, path, content FROM b UNION ALL SELECT 2, path, content FROM promoted UNION ALL SELECT 3, path, content FROM a)
SELECT place, path, sha256(content) AS digest FROM versions"""
)
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: two snapshots, the second's files of some sources promoted, the first restored; what each state reads back."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "doc_id").alias("path")
    changed = F.concat("text", F.when(F.col("n_chars") % 97 == 0, ".").otherwise("")).alias("content")
    kept = Versions(spark, shared_path(spark, "versions"))
    first = kept.snapshot(docs.select(path, F.col("text").alias("content")))
    second = kept.snapshot(docs.filter("n_chars % 89 <> 1").select(path, changed))
    kept.promote(first, second, docs.filter("right(source, 1) IN ('1', '3', '5')").select(path))
    kept.restore(first)
    states = [kept.read(v).select(F.lit(i).alias("place"), "path", F.sha2("content", 256).alias("digest")) for i, v in enumerate(kept.history())]
    return states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3])


@query(
    """WITH files AS (SELECT source || '/' || doc_id % 7 || '/' || doc_id || '.md' AS path FROM documents),
entries AS (SELECT path, path AS shown FROM files UNION SELECT source, source || '/' FROM documents UNION SELECT source || '/' || doc_id % 7, source || '/' || doc_id % 7 || '/' FROM documents),
found AS (SELECT shown FROM entries WHERE path LIKE '%1%'),
numbered AS (SELECT row_number() OVER (ORDER BY shown) AS place, shown AS line FROM found)
SELECT place, line FROM numbered WHERE place <= 40
UNION ALL SELECT 41, '... (' || (count(*) - 40) || ' more matches truncated)' FROM found HAVING count(*) > 40
UNION ALL SELECT 41, '(no matches)' FROM found HAVING count(*) = 0"""
)
def find_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and folders of documents whose path holds a 1: the first forty, and how many more there are."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id") % 7, F.lit("/"), F.col("doc_id"), F.lit(".md"))
    named = search.find_entries(docs.select(path.alias("path")), "path", "*1*", "both")
    return search.listing(named, 40)
