"""Shared fixtures: one local session, and a comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value by which a Spark row and a DuckDB row can be compared."""
    if isinstance(value, (bool, str, type(None))):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Fail unless the query returns the rows of the SQL on the same tables."""

    def check(query, sql: str, sf_dir: str = SF_DIR) -> int:
        con = duckdb.connect()
        for f in sorted(Path(sf_dir).glob("*.parquet")):
            path = f"{f}/*.parquet" if f.is_dir() else str(f)
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{path}')")
        cur = con.execute(sql)
        want_names = [c[0] for c in cur.description]
        want = rows_of(want_names, cur.fetchall())
        df = query(spark, sf_dir)
        got = rows_of(df.columns, df.collect())
        assert sorted(df.columns) == sorted(want_names)
        assert len(got) == len(want)
        wrong = [(g, w) for g, w in zip(got, want) if g != w]
        assert not wrong, f"{len(wrong)} rows differ, the first: {wrong[0]}"
        return len(got)

    return check
