"""Readers, sinks and streams, on small hand-made folders and the events table."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from stepwell.sources import readers, sinks
from stepwell.streaming import steps


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text, indent=1))


def test_trajectories_skip_files_that_are_no_objects(spark, tmp_path):
    put(tmp_path / "t1/agent/trajectory.json", {"steps": [{"source": "user"}, {"source": "agent"}], "dependencies": {"1": [0]}})
    put(tmp_path / "t2/agent/trajectory.json", {"steps": []})
    put(tmp_path / "t3/agent/trajectory.json", "{broken")
    put(tmp_path / "t4/agent/trajectory.json", [1, 2])
    put(tmp_path / "t5/agent/other.json", {"steps": []})
    rows = readers.trajectories(spark, str(tmp_path)).select("trial_id", F.size("steps").alias("n"), "dependencies").collect()
    assert sorted((r.trial_id, r.n, r.dependencies) for r in rows) == [("t1", 2, {"1": [0]}), ("t2", 0, None)]


def test_trial_results_default_to_zero(spark, tmp_path):
    full = {"agent_result": {"n_input_tokens": 7, "n_cache_tokens": 2, "n_output_tokens": 3}, "verifier_result": {"rewards": {"reward": 1.0}}}
    put(tmp_path / "repo__1__x/result.json", full)
    put(tmp_path / "repo__2__y/result.json", {"exception_info": {"exception_type": "Timeout"}})
    put(tmp_path / "repo__3__z/result.json", "")
    rows = readers.trial_results(spark, str(tmp_path)).drop("path").collect()
    assert sorted(tuple(r) for r in rows) == [("repo__1", 7, 2, 3, 1.0, None), ("repo__2", 0, 0, 0, 0.0, "Timeout")]


def test_id_lists(spark, tmp_path):
    put(tmp_path / "ids.txt", "# first\na\n\n b \na\n")
    put(tmp_path / "once.txt", "a\nb\n")
    path = str(tmp_path / "ids.txt")
    assert sorted(r.id for r in readers.id_list(spark, path).collect()) == ["a", "a", "b"]
    assert sorted(r.id for r in readers.strict_id_list(spark, str(tmp_path / "once.txt")).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="duplicate id: a"):
        readers.strict_id_list(spark, path).collect()


def test_checkpoint_takes_the_last_valid_record(spark):
    def line(n, step, version="1", more=""):
        return n, json.dumps({"schema_version": version, "annotator_fingerprint": "f", "step": step, "input_hash": "h", "more": more})

    records = [line(1, 1, more="old"), line(2, 1, more="new"), line(3, 2, version="0"), (4, "{cut"), (5, None)]
    rows = readers.checkpoint(spark.createDataFrame(records, "line_no long, value string"), "1", "f").collect()
    assert [(r.step, json.loads(r.value)["more"]) for r in rows] == [(1, "new")]


def test_task_pool(spark, tmp_path):
    put(tmp_path / "a/task.toml", '[metadata]\nrepository_url = "https://x/y"\n')
    put(tmp_path / "b/task.toml", '[metadata]\nrepository_url = ""\n')
    assert sorted(map(tuple, readers.task_pool(spark, str(tmp_path)).collect()), key=str) == [("a", "https://x/y"), ("b", None)]


def test_find_documents(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "n int, s string")
    found = readers.find_documents(rows, {"s": "a", "n": {"$gt": 1, "$lte": 3}}, ["n"])
    assert [tuple(r) for r in found.collect()] == [(3,)]
    assert readers.find_documents(rows, {"n": {"$in": [1, 2]}, "s": {"$ne": "b"}}).count() == 1
    assert readers.find_documents(rows, limit=2).count() == 2


def test_sinks(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = str(tmp_path / "parts")
    sinks.write_partitioned(first, path, "k")
    sinks.write_partitioned(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.json(path).collect()) == [("a", 1), ("b", 3)]
    log = str(tmp_path / "log")
    sinks.append_jsonl(first, log)
    sinks.append_jsonl(first, log)
    assert spark.read.json(log).count() == 4
    sinks.write_csv(first, str(tmp_path / "csv"), ["v"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["v"]
    odd = spark.createDataFrame([("a|b", None)], "k string, v int")
    assert sinks.markdown_table(odd) == "| k | v |\n| - | - |\n| a\\|b |  |"


def stream_rows(spark, frame, folder, name):
    """Rows of an available-now run that keeps every window."""
    run = (
        frame.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


@pytest.fixture()
def events(spark, tmp_path):
    """(the table, the table as a stream of four files)"""
    table = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "events")
    table.repartition(4).write.parquet(folder)
    return table, steps.event_stream(spark, folder, table.schema)


@pytest.mark.parametrize("slide", [None, "6 hours"])
def test_windowed_counts_as_in_batch(spark, events, tmp_path, slide):
    table, stream = events
    got = stream_rows(spark, steps.windowed_counts(stream, "1 day", "12 hours", slide), tmp_path, f"w{bool(slide):d}")
    want = sorted(map(tuple, steps.windowed_counts(table, "1 day", "12 hours", slide).collect()), key=repr)
    assert got == want and got


def test_sessions_as_in_batch(spark, events, tmp_path):
    table, stream = events
    got = stream_rows(spark, steps.sessions(stream, "1 day", "2 hours"), tmp_path, "sessions")
    want = sorted(map(tuple, steps.sessions(table, "1 day", "2 hours").collect()), key=repr)
    assert got == want and got


def test_upsert_annotates_only_what_is_new(spark, tmp_path):
    schema = "trial_id string, i int, input_hash string"
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows, name):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        # a new checkpoint folder: the stream starts over, the results stay
        steps.upsert_results(stream, lambda d: d.withColumn("by", F.lit(name)), path, str(tmp_path / name)).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(path).collect()))

    run([("a", 1, "x"), ("a", 2, "y")], "one")
    got = run([("a", 2, "z"), ("b", 1, "x"), ("b", 1, "x")], "two")
    assert got == [("a", 1, "x", "one"), ("a", 2, "y", "one"), ("a", 2, "z", "two"), ("b", 1, "x", "two")]
