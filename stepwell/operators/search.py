"""Lines of texts: ranges, tails, regex search, files by glob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.functions.steps import glob_regex


def lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line_no from 1, line, total)."""
    parts = F.split(F.col(text), "\n")
    return files.select(F.col(path).alias("path"), F.size(parts).cast("bigint").alias("total"), F.posexplode(parts).alias("p", "line")).select(
        "path", (F.col("p") + 1).cast("bigint").alias("line_no"), "line", "total"
    )


def line_range(rows: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    return rows.filter((F.col("line_no") >= first) & (F.col("line_no") <= last))


def tail(rows: DataFrame, n: int) -> DataFrame:
    return rows.filter(F.col("line_no") > F.col("total") - n)


def grep(rows: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """Matching lines in (path, line) order; ``most`` keeps the first ones."""
    found = rows.filter(F.col("line").rlike(pattern)).select("path", "line_no", "line")
    return found.orderBy("path", "line_no").limit(most) if most else found


def find(files: DataFrame, path: str, glob: str, depth: int | None = None) -> DataFrame:
    """Files whose path or base name matches a glob, down to a depth."""
    regex = glob_regex(glob)
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    found = files.filter(F.col(path).rlike(regex) | base.rlike(regex))
    return found.filter(F.size(F.split(F.col(path), "/")) <= depth) if depth else found


def find_entries(files: DataFrame, path: str, glob: str, kind: str = "files", max_depth: int | None = None) -> DataFrame:
    """Files, folders (``dirs``, with a closing slash) or ``both`` whose path or name matches a glob: column ``path``.

    Folders are those above the files.  ``max_depth`` counts the folders between the root and an
    entry: 0 is the root's own entries.  Null paths and repeats are left out.
    """
    regex = glob_regex(glob)
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    known = files.filter(F.col(path).isNotNull())
    in_files = known.select(F.col(path).alias("path"), F.lit("").alias("close"))
    in_folders = known.filter(F.size(parts) > 1).select(F.explode(above).alias("path"), F.lit("/").alias("close"))
    found = {"files": in_files, "dirs": in_folders, "both": in_files.unionByName(in_folders)}[kind]
    found = found.filter(F.col("path").rlike(regex) | F.regexp_extract("path", r"([^/]*)$", 1).rlike(regex))
    if max_depth is not None:
        found = found.filter(F.size(F.split("path", "/")) - 1 <= max_depth)
    return found.select(F.concat("path", "close").alias("path")).distinct()


def listing(found: DataFrame, most: int = 50) -> DataFrame:
    """(place, line): the first ``most`` paths in order, then one line that counts the others; or that there is none."""
    place = F.row_number().over(Window.orderBy("path"))  # of the kept rows alone
    shown = found.orderBy("path").limit(most).select(place.cast("bigint").alias("place"), F.col("path").alias("line"))
    n = F.count("*")
    note = F.when(n == 0, "(no matches)").when(n > most, F.concat(F.lit("... ("), n - most, F.lit(" more matches truncated)")))
    return shown.unionByName(found.agg(F.lit(most + 1).cast("bigint").alias("place"), note.alias("line")).filter("line IS NOT NULL"))
