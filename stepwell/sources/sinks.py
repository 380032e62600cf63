"""Sinks: reports and tables, all through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_partitioned(df: DataFrame, path: str, key: str) -> None:
    """One folder per key; only the keys in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def markdown_rows(df: DataFrame) -> DataFrame:
    """One Markdown table row per row, pipes escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report of at most ``most`` rows as text; a last line says if there were more (``markdown_rows`` has all)."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " - |" * len(df.columns)
    lines = [r.line for r in markdown_rows(df).limit(most + 1).collect()]
    return "\n".join([head, *lines[:most], *([f"\nOnly the first {most} rows are shown."] if len(lines) > most else [])])
