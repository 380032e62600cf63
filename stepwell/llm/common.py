"""Shared helpers: input columns, the shared folder, tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share.

    It lies in ``spark.checkpoint.dir``.  Where that is unset it lies in the warehouse,
    or, in local mode alone, where driver and executors are one process, in a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="stepwell-"))
        path = f"file://{_OWN_DIR[0]}"
    path = path or spark.conf.get("spark.sql.warehouse.dir")
    return f"{path.rstrip('/')}/stepwell-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here.

    Results read such tables, so they stay until `discard` or `clear` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by `materialise` that is read no more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Remove all tables of this application, once no result that reads them is needed."""
    _delete(spark, shared_dir(spark))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long), ``text`` (null: empty) and ``uid``.

    Rows with the same id and text share a uid and get the same results; rows with
    the same id and different texts are different documents with that id.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "uid", F.xxhash64("doc_id", "text")
    )


def row_uid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The uid that `documents` gives a row."""
    return F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))


#: Keys (16 bytes each) that may be broadcast to pick or drop documents.
MAX_KEYS = 1_000_000


def checked_broadcast(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if a count proves it small; else left to a shuffle."""
    return F.broadcast(keys) if keys.count() <= MAX_KEYS else keys


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
