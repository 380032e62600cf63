"""The near-copy stage of the pipeline against all pairs of shingle sets."""

from __future__ import annotations

import os
import random

import pytest

import brute
import corpus_pipeline
from stepwell.llm import common, jaccard_join, near_copies, simhash

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shingles(text: str | None) -> frozenset:
    w = brute.WORD.findall((text or "").translate(brute.LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 9 * min(len(x), len(y)) >= 4 * (len(x) + len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a_top, b_top = sorted((root(a), root(b)))
                top[b_top] = a_top
    return {d: root(d) for d in ids}


def edited():
    """Texts at all similarities about 0.8, a large group of near copies, and short ones."""
    rng = random.Random(7)
    rows = []
    for n in (6, 12, 40, 300):
        text = [f"t{n}w{i}" for i in range(n)]
        for k in range(12):
            copy = list(text)
            for _ in range(k):
                copy[rng.randrange(n)] = f"e{rng.random()}"
            rows.append(" ".join(copy))
    text = [f"hot{i}" for i in range(100)]
    for k in range(60):
        copy = list(text)
        for _ in range(k % 4):
            copy[rng.randrange(100)] = f"h{rng.random()}"
        rows.append(" ".join(copy))
    rows += ["", None, " \n", "One two", "one  TWO", "one two three", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("kind", ["tables", "edited", "empty"])
def test_near_copy_stage(spark, kind):
    rows = {"edited": edited(), "empty": []}.get(kind)
    if rows is None:
        rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == want
    if kind != "tables":
        kept = [r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()]
        assert sorted(kept) == sorted(set(want.values()))


def test_near_copy_stage_goes_by_fingerprints(spark, monkeypatch):
    """Pairs that SimHash gives are compared; the join looks only between the components they make."""
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given, asked = [], []
    find = simhash.candidates

    def candidates(*args):
        given.extend(find(*args).collect())
        return docs.sparkSession.createDataFrame(given, "a long, b long")

    monkeypatch.setattr(simhash, "candidates", candidates)
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, label: asked.append((label, out := common.materialise(df, label))) or out)
    corpus_pipeline.dedup_documents(spark, docs, "").collect()
    firsts = next(df for label, df in asked if label == "links").collect()
    assert given and firsts and {tuple(sorted(r)) for r in firsts} <= {tuple(sorted(r)) for r in given}
    roots = {r.node: r.root for r in next(df for label, df in asked if label == "roots").collect()}
    pairs = next(df for label, df in asked if label == "pairs").collect()
    assert pairs and all(roots.get(r.a, r.a) != roots.get(r.b, r.b) for r in pairs)


def test_fewer_keys_are_broadcast_and_samples_come_as_arrow(spark, monkeypatch):
    """Of 40 texts and 3 copies 3 keys go out, not 40; the driver makes no Python object of a shingle."""
    rows = [(i, " ".join(f"t{i % 40}w{k}" for k in range(8))) for i in range(43)]
    monkeypatch.setattr(jaccard_join, "MAX_KEYS", 10)
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("rows become Python objects"))
    asked = []

    def ahead(one, reps):
        asked.append(one.count())
        return reps.select("sid", "sid").toDF("a", "b").filter("a <> b")

    found = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), width=5, jaccard=(4, 5), ahead=ahead)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 40 for i in range(43)}
    assert asked == [40]
