"""The line stage of the pipeline against brute force over all windows of lines."""

from __future__ import annotations

import os
import re

import pytest

import corpus_pipeline

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
INK = re.compile("[^ \\t\\r\\x0b\\x0c]")


def left(rows):
    """doc_id -> text without later copies of three lines, or of one or two with 50 words."""
    inked = {d: [i for i, s in enumerate((t or "").split("\n")) if INK.search(s)] for d, t in rows}
    lines = {d: (t or "").split("\n") for d, t in rows}
    first, gone = set(), {d: set() for d, _ in rows}
    for d in sorted(lines):
        for n in (1, 2, 3):
            for p in range(len(inked[d]) - n + 1):
                at = inked[d][p : p + n]
                run = tuple(lines[d][i] for i in at)
                if n < 3 and sum(len(re.findall("[^ \\t\\r\\x0b\\x0c]+", s)) for s in run) < 50:
                    continue
                if run in first:
                    gone[d].update(at)
                first.add(run)
    kept = {d: "\n".join(s for i, s in enumerate(lines[d]) if i not in gone[d]) for d in lines}
    return {d: t for d, t in kept.items() if not gone[d] or INK.search(t)}


LONG = " ".join(f"w{i}" for i in range(50))
HALF, REST = " ".join(f"h{i}" for i in range(24)), " ".join(f"r{i}" for i in range(26))
ROWS = [
    (1, f"a\n{LONG}\nb"), (2, f"c\n\n{LONG}\nd"), (3, LONG), (4, f"{HALF}\n{REST}"), (5, f"x\n{HALF}\n\n{REST}\ny"),
    (6, HALF), (7, f"{HALF}\nz"), (8, "p\nq\nr"), (9, "p\nq\nr\ns"), (10, None), (11, ""), (12, f"{LONG}\n{LONG}"), (13, "p\nq"),
]


@pytest.mark.parametrize("kind", ["rows", "tables", "empty"])
def test_line_stage(spark, kind):
    rows = {"rows": ROWS, "empty": []}.get(kind)
    if rows is None:
        rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0L AS n_chars")
    got = {r.doc_id: r.text or "" for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == left(rows)
