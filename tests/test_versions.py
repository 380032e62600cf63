"""Versions of files: contents, sharing, promotion of allowed paths, and writers that meet."""

from __future__ import annotations

import pytest

from stepwell.sources.versions import Versions

FILES = "path string, content string, holder string"


@pytest.fixture
def kept(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/kept")


def table(spark, files):
    return spark.createDataFrame([(p, c, "clash") for p, c in files.items()], FILES)


def held(kept, version=None):
    return {r.path: r.content for r in kept.read(version).collect()}


def test_snapshot_restore_and_what_is_written(spark, kept):
    assert kept.current() is None and kept.history() == [] and held(kept) == {}
    first, second = {"a": "1", "b": "2", "n": None}, {"a": "1", "b": "3", "c": "", "n": None}
    v1 = kept.snapshot(table(spark, first))
    v2 = kept.snapshot(table(spark, second))
    assert held(kept) == second and held(kept, v1) == first
    assert sorted(r.path for r in spark.read.parquet(f"{kept.root}/contents/holder={v2}").collect()) == ["b", "c"]
    kept.restore(v1)
    assert held(kept) == first and kept.history() == [v1, v2, v1]
    v3 = kept.snapshot(table(spark, {}))
    assert held(kept) == {} and kept.current() == v3
    with pytest.raises(ValueError):
        kept.restore("v0")


def test_promotion_takes_allowed_paths_alone(spark, kept):
    base = kept.snapshot(table(spark, {"tools": "t", "run": "r", "gone": "g", "other": "o"}))
    candidate = kept.snapshot(table(spark, {"tools": "t2", "run": "r2", "other": "o2", "extra": "x"}))
    kept.restore(base)
    allowed = spark.createDataFrame([("tools",), ("gone",), ("tools",), (None,), ("absent",)], "path string")
    version = kept.promote(base, candidate, allowed)
    assert kept.current() == version and held(kept) == {"tools": "t2", "run": "r", "other": "o"}


def test_refused_writes_leave_the_current_version(spark, kept):
    first = kept.snapshot(table(spark, {"a": "1"}))
    for rows in ([("a", "1", ""), ("a", "2", "")], [(None, "1", "")]):
        with pytest.raises(ValueError):
            kept.snapshot(spark.createDataFrame(rows, FILES))
    with pytest.raises(RuntimeError):
        kept._switch("late", 0)  # a writer that began before the first version
    assert kept.history() == [first] and held(kept) == {"a": "1"}
    again = kept.snapshot(table(spark, {"a": "2"}))
    assert kept.current() == again
