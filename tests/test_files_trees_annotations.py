"""JSON lines in many splits, Merkle trees and incremental annotation on awkward input."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from stepwell.operators import merkle
from stepwell.sources.jsonl import checkpoint_files, numbered_lines
from stepwell.streaming import annotation


def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def usual_splits(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rng = random.Random(1)
    texts = {
        "a.jsonl": "".join("x" * rng.choice([0, 3, 90, 2000]) + "\n" for _ in range(200)),
        "b.jsonl": "no newline at the end",
        "sub/c.jsonl": "\n\n\r\nlast é\r\n" * 40,
        "empty.jsonl": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    small_splits(spark)
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        got = sorted((r.file.split("/")[-1], r.line_no, r.value) for r in lines.collect())
    finally:
        usual_splits(spark)
    want = []
    for name, text in texts.items():
        cut = text.replace("\r\n", "\n").split("\n")
        want += [(name.split("/")[-1], i, line) for i, line in enumerate(cut[:-1] if cut[-1] == "" else cut, 1)]
    assert got == sorted(want)


def test_last_valid_record_of_a_file_wins(spark, tmp_path):
    rng = random.Random(3)
    want: dict = {}
    for name in ("one", "two"):
        lines = []
        for i in range(1, 401):
            step, version, fingerprint = rng.randrange(9), rng.choice(["v", "v", "old"]), rng.choice(["f", "f", "g"])
            record = json.dumps({"schema_version": version, "annotator_fingerprint": fingerprint, "step": step, "input_hash": f"h{i % 2}", "i": i})
            broken = rng.random() < 0.2
            lines.append(rng.choice([record[:-4], "", "[1]", "null", '{"step": "x"}']) if broken else record)
            if not broken and version == "v" and fingerprint == "f":
                want[name, step, f"h{i % 2}"] = (i, i)
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    small_splits(spark)
    try:
        rows = checkpoint_files(spark, str(tmp_path), "v", "f").collect()
    finally:
        usual_splits(spark)
    got = {(r.file.split("/")[-1].split(".")[0], r.step, r.input_hash): (r.line_no, json.loads(r.value)["i"]) for r in rows}
    assert len(got) == len(rows) and got == want


def files(spark, rows):
    return spark.createDataFrame(rows, "g string, p string, d string")


def test_merkle_changes_are_the_differing_files(spark):
    rng = random.Random(6)
    old = [(rng.choice(["a", "b", None]), f"p{i}", f"d{i}") for i in range(600)]
    new = [(g, p, "other" if i % 50 == 3 else None if i % 90 == 7 else d) for i, (g, p, d) in enumerate(old) if i % 70 != 5]
    new += [("a", "fresh", "x"), ("new", "p1", "y")]
    was, now = {(g, p): d for g, p, d in old}, {(g, p): d for g, p, d in new}
    want = {(g, p, was.get((g, p)), now.get((g, p))) for g, p in was.keys() | now.keys() if was.get((g, p), 0) != now.get((g, p), 0)}
    for depth in (None, 1, 2, 3):
        rows = [tuple(r) for r in merkle.changes(files(spark, old), files(spark, new), "g", "p", "d", depth).collect()]
        assert len(rows) == len(want) and set(rows) == want
    assert merkle.changes(files(spark, old), files(spark, old), "g", "p", "d").collect() == []
    assert len(merkle.changes(files(spark, []), files(spark, new), "g", "p", "d").collect()) == len(new)


def test_merkle_descent_leaves_equal_subtrees_out(spark):
    old = [("a", f"p{i}", "d") for i in range(2000)]
    new = [(g, p, "e" if p == "p77" else d) for g, p, d in old]
    trees = [merkle.nodes(files(spark, t), "g", "p", "d", 2) for t in (old, new)]
    assert merkle.differing_leaves(*trees, "g", 2).count() == 1
    assert merkle.depth_for(10) == 1 and merkle.depth_for(64 * 16**3) == 3


def test_annotation_runs_only_over_new_inputs(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    seen = spark.sparkContext.accumulator(0)

    def annotate(rows):
        count = F.udf(lambda s: (seen.add(1), s)[1])
        return rows.withColumn("label", count("step"))

    def run(rows):
        spark.createDataFrame(rows, "step string, h string, fp string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("step string, h string, fp string").parquet(source)
        before = seen.value
        annotation.annotate_once(stream, ["step", "h", "fp"], annotate, out, state).awaitTermination()
        return seen.value - before

    assert run([("1", "a", "f"), ("2", "b", "f"), ("1", "a", "f"), (None, "a", "f")]) == 3
    assert run([("2", "b", "f"), ("3", "c", "f")]) == 1
    assert run([("1", "a", "g"), ("2", "b", "f"), ("3", "changed", "f")]) == 2
    assert run([("1", "a", "f")]) == 0
    rows = annotation.annotated(spark, out, "step string, h string, fp string, label string")
    assert rows.count() == 6 and rows.distinct().count() == 6
