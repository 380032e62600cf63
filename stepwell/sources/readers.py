"""Readers: trajectories, trial results, id lists, checkpoints, databases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StringType

STEP = (
    "struct<source:string,message:string,action:string,tool_calls:array<struct<tool_call_id:string,function_name:string,"
    "arguments:map<string,string>>>,observation:string,metrics:map<string,string>>"
)


def json_files(spark: SparkSession, root: str, name: str, contains: str | None = None) -> DataFrame:
    """(path, doc): whole JSON objects below a folder; doc is null where a file is none."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    rows = rows.withColumn("doc", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.col("doc")))
    return rows.filter(F.col("path").contains(contains)) if contains else rows


def trajectories(spark: SparkSession, root: str, contains: str | None = None) -> DataFrame:
    """(trial_id, path, steps as an array of variants, dependencies)."""
    files = json_files(spark, root, "trajectory.json", contains).filter(F.col("doc").isNotNull())
    return files.select(
        F.regexp_extract("path", r"([^/]+)/agent/[^/]*$", 1).alias("trial_id"),
        "path",
        F.try_variant_get("doc", "$.steps", "array<variant>").alias("steps"),
        F.try_variant_get("doc", "$.dependencies", "map<string,array<int>>").alias("dependencies"),
    )


def trial_results(spark: SparkSession, root: str) -> DataFrame:
    """Token counts, reward and exception of every result file; the case is the folder's first two __ parts."""
    files = json_files(spark, root, "result.json").filter(F.col("doc").isNotNull())
    folder = F.split(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), "__")

    def number(field: str) -> Column:
        return F.coalesce(F.try_variant_get("doc", f"$.agent_result.{field}", "bigint"), F.lit(0))

    return files.select(
        "path",
        F.array_join(F.slice(folder, 1, 2), "__").alias("case_id"),
        number("n_input_tokens").alias("n_input"),
        number("n_cache_tokens").alias("n_cached"),
        number("n_output_tokens").alias("n_output"),
        F.coalesce(F.try_variant_get("doc", "$.verifier_result.rewards.reward", "double"), F.lit(0.0)).alias("reward"),
        F.try_variant_get("doc", "$.exception_info.exception_type", "string").alias("exception"),
    )


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, blanks and # comments dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> '' AND NOT startswith(id, '#')")


def strict_id_list(spark: SparkSession, path: str) -> DataFrame:
    """As `id_list`; an empty list raises at once, an id that occurs twice when the list is read."""
    ids = id_list(spark, path)
    if ids.isEmpty():
        raise ValueError(f"no ids in {path}")
    ids = ids.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    fine = F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate id: "), F.col("id")))
    return ids.filter(fine.isNull()).select("id")


def trial_configs(spark: SparkSession, root: str) -> DataFrame:
    """(trial_dir, task_path, case_id) of configs that name a task; those of whole runs don't."""
    files = json_files(spark, root, "config.json").filter(F.col("doc").isNotNull())
    task = F.try_variant_get("doc", "$.task.path", "string")
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("trial_dir"), task.alias("task_path"))
    case = F.regexp_extract(F.regexp_replace("task_path", "/+$", ""), "([^/]*)$", 1)
    return rows.filter(F.coalesce("task_path", F.lit("")) != "").withColumn("case_id", case)


def final_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Token totals and the number of all steps of every trajectory; the case is the first __ part of its trial."""
    files = json_files(spark, root, "trajectory.json").filter(F.col("doc").isNotNull())
    number = lambda f: F.coalesce(F.try_variant_get("doc", f"$.final_metrics.{f}", "bigint"), F.lit(0))
    return files.select(
        "path",
        F.split(F.regexp_extract("path", r"([^/]+)/(?:agent/)?[^/]*$", 1), "__")[0].alias("case_id"),
        number("total_prompt_tokens").alias("n_input"),
        number("total_cached_tokens").alias("n_cached"),
        number("total_completion_tokens").alias("n_output"),
        F.coalesce(F.size(F.try_variant_get("doc", "$.steps", "array<variant>")), F.lit(0)).cast("bigint").alias("steps"),
    )


def valid_records(records: DataFrame, version: str, fingerprint: str) -> DataFrame:
    """``records`` whose ``value`` is a record of this version and fingerprint, with its step and input_hash."""
    doc = F.try_parse_json("value")
    rows = records.select(
        *records.columns,
        F.try_variant_get(doc, "$.schema_version", "string").alias("version"),
        F.try_variant_get(doc, "$.annotator_fingerprint", "string").alias("fingerprint"),
        F.try_variant_get(doc, "$.step", "bigint").alias("step"),
        F.try_variant_get(doc, "$.input_hash", "string").alias("input_hash"),
    )
    return rows.filter((F.col("version") == version) & (F.col("fingerprint") == fingerprint) & F.col("step").isNotNull())


def checkpoint(records: DataFrame, version: str, fingerprint: str) -> DataFrame:
    """Last valid record of every (step, input_hash); ``records`` has (line_no, value)."""
    rows = valid_records(records.select("line_no", "value"), version, fingerprint)
    return rows.groupBy("step", "input_hash").agg(F.max_by("value", "line_no").alias("value"))


@F.pandas_udf(StringType())
def _repository(toml: pd.Series) -> pd.Series:
    import tomllib

    def one(text: str) -> str | None:
        try:
            url = tomllib.loads(text).get("metadata", {}).get("repository_url")
        except (tomllib.TOMLDecodeError, AttributeError):
            return None
        return url if isinstance(url, str) and url.strip() else None

    return toml.map(one)


def task_pool(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, repository_url) of every task.toml below a folder; null where the file or its [metadata] has none."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "task.toml").text(folder, wholetext=True)
    task = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/task\.toml$", 1)
    return raw.select(task.alias("task_id"), "value").select("task_id", _repository("value").alias("repository_url"))


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on SQLite, DuckDB or Postgres over JDBC; the text goes there as it is."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def find_documents(collection: DataFrame, filters: dict | None = None, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A document store's find on a table: equality and $gt $gte $lt $lte $ne $in filters."""
    compare = {
        "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v,
        "$lte": lambda c, v: c <= v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(v),
    }
    out = collection
    for name, want in (filters or {}).items():
        for op, value in want.items() if isinstance(want, dict) else [("", want)]:
            out = out.filter(compare[op](F.col(name), value) if op else F.col(name) == value)
    out = out.select(*fields) if fields else out
    return out.limit(limit) if limit else out


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a folder as views, for queries by name."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def catalog(spark: SparkSession) -> list[tuple[str, str]]:
    """Databases and their tables."""
    return [(d.name, t.name) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name)]
