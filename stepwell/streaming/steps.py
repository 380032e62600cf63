"""Structured Streaming over step events (an extension: event time and new steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream with ``ts`` as a timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and values per window and type; a window is closed behind the watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, late: str, gap: str) -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def only_new(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps without a result for the same input."""
    return steps.join(done.select("trial_id", "i", "input_hash"), ["trial_id", "i", "input_hash"], "left_anti")


def upsert_results(stream: DataFrame, annotate, path: str, checkpoint: str):
    """Annotates what is not in the table at ``path`` yet, one batch at a time."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        once = rows.dropDuplicates(["trial_id", "i", "input_hash"])
        annotate(only_new(once, done) if done is not None else once).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
