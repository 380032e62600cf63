"""Incremental annotation: every input is annotated once, however often and late it comes.

The keys of inputs seen are state of the stream (a key takes a few bytes in the state store and
is dealt out by hash), so a batch reads neither the results so far nor old inputs.  The file
sink's log makes a restarted batch count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Keys of all inputs outgrow the heap; this store keeps them on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def annotate_once(
    stream: DataFrame, keys: list[str], annotate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Start a run over all that is there and not yet seen; the results are appended to ``path``.

    ``keys`` name the step, the hash of its input and the annotator's fingerprint: a step comes
    again if one of them changed, and no other step does.  Of rows that share all keys the
    first that arrives is annotated.  ``annotate`` gets the new rows and keeps their number.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    fresh = annotate(stream.dropDuplicates(keys))
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def annotated(spark: SparkSession, path: str, schema) -> DataFrame:
    """The results so far, as the sink's log has them; none before the first run."""
    return spark.read.schema(schema).parquet(path)
