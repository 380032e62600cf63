"""Readers of configs, metrics, tasks and id lists; rules on tool lists and on merged writes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stepwell.operators import quality, signals
from stepwell.sources import readers


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_configs_of_runs_are_no_trials(spark, tmp_path):
    write(tmp_path / "config.json", {"run": 1})
    write(tmp_path / "t1" / "config.json", {"task": {"path": "tasks/case-a/"}})
    write(tmp_path / "t2" / "config.json", "{")
    got = readers.trial_configs(spark, str(tmp_path)).collect()
    assert [(r.case_id, r.task_path, r.trial_dir.endswith("/t1")) for r in got] == [("case-a", "tasks/case-a/", True)]


def test_metrics_count_all_steps(spark, tmp_path):
    write(tmp_path / "own__case__x" / "agent" / "trajectory.json", {"steps": [{}, {"source": "agent"}], "final_metrics": {"total_prompt_tokens": 7}})
    write(tmp_path / "b" / "agent" / "trajectory.json", [])
    row = readers.final_metrics(spark, str(tmp_path)).collect()
    assert [(r.case_id, r.n_input, r.n_cached, r.n_output, r.steps) for r in row] == [("own", 7, 0, 0, 2)]


def test_tasks_are_read_as_toml(spark, tmp_path):
    write(tmp_path / "a" / "task.toml", "[metadata]\nrepository_url = 'https://g.example/o/r'  # single quotes\n")
    write(tmp_path / "b" / "task.toml", '[other]\nrepository_url = "https://g.example/x/y"\n')
    write(tmp_path / "c" / "task.toml", "[metadata\n")
    got = {r.task_id: r.repository_url for r in readers.task_pool(spark, str(tmp_path)).collect()}
    assert got == {"a": "https://g.example/o/r", "b": None, "c": None}


def test_strict_lists(spark, tmp_path):
    for name, text in (("fine", "a\n# no\n\n b \n"), ("empty", "# none\n"), ("twice", "a\na\n")):
        write(tmp_path / name, text)
    assert sorted(r.id for r in readers.strict_id_list(spark, str(tmp_path / "fine")).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.strict_id_list(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception, match="duplicate id"):
        readers.strict_id_list(spark, str(tmp_path / "twice")).collect()


def test_tool_lists(spark):
    tool = lambda n: {"function": {"name": n, "parameters": {"type": "object"}}}
    cases = [
        ([tool("a"), {"name": "b", "parameters": {}}], []), ({"a": 1}, ["not_a_list"]), ([tool("a"), tool("a")], ["duplicate_names"]),
        ([{"name": "a"}, {"parameters": {}}], ["missing_name", "parameters_not_object"]), ([], []),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{")], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", quality.harness_issues(F.col("t")).alias("x")).collect()}
    assert got == {**{i: w for i, (_, w) in enumerate(cases)}, 99: ["not_a_list"]}


def test_writes_merge_only_on_files_apart(spark):
    rows = [(t, i, k, "success", True, [0], 5, f, s) for t, k, files, structured in (
        (1, "write", [["a"], ["b"]], [True, True]), (2, "write", [["a"], ["a"]], [True, True]), (3, "write", [["a"], []], [True, True]), (4, "read", [[], []], [True, True]), (5, "read", [["a"], ["b"]], [True, False]),
    ) for i, (f, s) in enumerate(zip(files, structured), 1)]
    kept = spark.createDataFrame(rows, "trial_id long, i int, op_type string, op_state string, kept boolean, deps array<int>, obs_chars long, files array<string>, structured boolean")
    assert sorted(r.trial_id for r in signals.mergeable(kept).collect()) == [1, 4]
