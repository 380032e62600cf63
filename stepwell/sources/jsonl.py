"""JSON lines with their line numbers, over any folder that Spark reads.

A file of any size is read in splits by many tasks, and a split doesn't know how many lines lie
before it.  Tasks number the lines of each split; the counts of the splits before it in
the file are added (one row a split).  Lines end as Spark's text reader says: at a newline, a carriage
return or both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwell.sources.readers import valid_records


def _local_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, value) in the order of the file -> with the line's place in its split, from 1."""
    last, done = None, 0
    for batch in batches:
        split = batch.column("split").to_numpy()
        file = batch.column("file").dictionary_encode()
        code, names = file.indices.to_numpy(), file.dictionary
        cuts = np.flatnonzero(np.r_[True, (split[1:] != split[:-1]) | (code[1:] != code[:-1])]) if len(split) else np.zeros(0, np.int64)
        place = np.empty(len(split), np.int64)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(split)]):
            key = (names[int(code[lo])].as_py(), int(split[lo]))
            done = done if key == last else 0
            place[lo:hi] = np.arange(done + 1, done + 1 + hi - lo)
            last, done = key, done + hi - lo
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line of the text files at a path, numbered from 1 in its file."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    lines = raw.mapInArrow(_local_numbers, "file string, split long, value string, place long")
    counts = raw.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "split"]).select("file", (F.col("before") + F.col("place")).alias("line_no"), "value")


def checkpoint_files(spark: SparkSession, path: str, version: str, fingerprint: str) -> DataFrame:
    """(file, step, input_hash, line_no, value): the last valid record of each step and input in its file.

    Lines that are no JSON object of this version and fingerprint with a step are passed
    over, a torn last line too.  An empty folder gives no rows.
    """
    rows = valid_records(numbered_lines(spark, path), version, fingerprint)
    last = F.max_by(F.struct("line_no", "value"), "line_no").alias("last")
    return rows.groupBy("file", "step", "input_hash").agg(last).select("file", "step", "input_hash", "last.line_no", "last.value")
