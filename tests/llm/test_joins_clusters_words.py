"""Jaccard join, annulus clusters and spelling variants against brute force."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from stepwell.llm import annulus, common, jaccard_join, spelling
from stepwell.llm.queries import QUERIES
from test_contracts import ROWS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("uid", "sid", "region", "root", "n", "word", "h", "part"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    return docs


def near_group(size: int, seed: int = 5):
    """Copies of one text with a few words changed, some of them linked over others only."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(40)}"
        out.append(" ".join(words))
    return out


def joined(df):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in df.select("doc_id", "n_shingles", "component_id").collect()]
    return sorted(got, key=repr)


def test_op11_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.jaccard_components(rows)
    assert joined(QUERIES["op11_jaccard_join"](spark, SF_DIR)) == sorted(((d, n, c) for d, (n, c) in want.items()), key=repr)


@pytest.mark.parametrize("pivots", [1024, 3, 0])
def test_op11_awkward_rows(spark, pivots, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    rows = ROWS + [(100 + i, t) for i, t in enumerate(near_group(12))] + [(200, "one"), (201, "ONE"), (202, "one two"), (203, "　 a")]
    want = brute.jaccard_components(rows)
    twice = rows + [(1, "Alpha beta gamma delta epsilon.")]
    got = joined(jaccard_join.join_components(documents(spark, twice)))
    assert got == sorted([(d, *want[d]) for d, _ in twice], key=repr)
    assert jaccard_join.join_components(documents(spark, [])).collect() == []


@pytest.mark.parametrize("pivots", [64, 0])
def test_op11_large_regions(spark, pivots, monkeypatch):
    for name, value in (("PIVOTS", pivots), ("LARGE", 8), ("CELL", 8), ("SUB_PIVOTS", 3), ("CHUNK", 16), ("BLOCK", 7), ("MAX_KEYS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = list(enumerate(near_group(120) + near_group(60, 6)[::-1] + [f"only {i} of a kind {i * 7}" for i in range(40)]))
    want = brute.jaccard_components(rows)
    assert len({c for _, c in want.values()}) > 45
    assert joined(jaccard_join.join_components(documents(spark, rows))) == sorted(((d, n, c) for d, (n, c) in want.items()), key=repr)


def test_op11_near_copies_meet_few_pivots(spark, monkeypatch):
    """What is made for a group of near copies grows with its sets, not with the pivots drawn from it."""
    rng = random.Random(3)
    texts = []
    for i in range(240):
        words = [f"w{k}" for k in range(150)]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(150)] = f"new{rng.random()}"
        texts.append(" ".join(words))
    made = {}
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, label: made.setdefault(label, []).append(out := common.materialise(df, label)) or out)
    rows = list(enumerate(texts))
    want = brute.jaccard_components(rows)
    assert joined(jaccard_join.join_components(documents(spark, rows))) == sorted(((d, n, c) for d, (n, c) in want.items()), key=repr)
    assert made["rows"][0].filter("d > 0").count() <= jaccard_join.CROWD * len(texts)
    posted, pairs = made["posted"][0], made["pairs"][1]
    assert 0 < posted.count() <= 17 * len(texts)  # linked sets of 148 shingles differ by 16
    assert pairs.count() <= 10 * len(texts)


def test_op11_null_ids(spark):
    text = near_group(1)[0]
    rows = [(None, text), (7, text), (None, "a b c d"), (3, text + " w w")]
    got = joined(jaccard_join.join_components(documents(spark, rows)))
    assert got == sorted([(None, 148, 3), (7, 148, 3), (3, 150, 3), (None, 2, None)], key=repr)


def test_op12_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = [tuple(r) for r in QUERIES["op12_annulus_clusters"](spark, SF_DIR).collect()]
    assert sorted(got, key=repr) == brute.clusters(rows)


def test_op12_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40, 4)) * 2) / 2  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(50, None), (51, []), (52, [1.0] * 3), (53, [None, 1.0, 1.0, 1.0]), (54, [nan, 1.0, 1.0, 1.0]), (55, [inf, 0.0, 0.0, 0.0])]
    odd += [(None, [1.0] * 4), (3, [0.5, 0.0, 0.0, 0.0]), (3, [0.5, 0.0, 0.0, 0.0]), (56, [0.0] * 4), (57, [3e38, -3e38, 1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x"))
    for k in (5, 100):
        got = [tuple(r) for r in annulus.clusters(df, k=k, dim=4).collect()]
        assert sorted(got, key=repr) == brute.clusters(rows + odd, k=k, dim=4)
    assert annulus.clusters(df.limit(0), dim=4).collect() == []
    assert annulus.clusters(df.filter("vec_id IS NULL"), dim=4).collect() == []


def test_op12_annulus_leaves_centroids_out():
    centres = annulus.Centroids([[10 * i, 0] for i in range(100)])
    x = np.array([[503, 2], [0, 0], [991, 5], [505, 0]])
    name, best, work = centres.nearest(x)
    assert name.tolist() == [50, 0, 99, 50] and best.tolist() == [13, 0, 26, 25]
    assert work < 20


def variants_of(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_op13_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.spellings(rows)
    assert any(v[2] for v in want.values())
    assert variants_of(QUERIES["op13_spelling_variants"](spark, SF_DIR)) == want


@pytest.mark.parametrize("words", [20_000, 4])
def test_op13_awkward_words(spark, words, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS", words)
    monkeypatch.setattr(spelling, "PIECE", 500)
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (6, words))
    rng = random.Random(11)
    stems = ["abcabc", "abcabcd", "aaaaaa", "aaaaaaa", "colorés", "Harbour", "harbor", "À×÷ÿzz", "banana"]
    text = []
    for _ in range(1500):
        w = rng.choice(stems)
        if rng.random() < 0.3:
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice("abz") + w[i + rng.randrange(2) :]
        text.append(w)
    rows = [(1, " ".join(text[:700])), (2, "1".join(text[700:1200])), (None, " ".join(text[1200:])), (4, None), (5, ""), (6, "a" * 4000), (2, "harbour " * 9)]
    for every in (199, 3):
        got = variants_of(spelling.variants(documents(spark, rows), every=every))
        assert got == brute.spellings(rows, every)
    assert spelling.variants(documents(spark, [])).collect() == []


def test_op13_roots_follow_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w4")]
    got = {r.word: r.root for r in spelling._roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "x": "w9"}


def test_op13_automaton_is_minimal_and_numbers_words():
    words = sorted({a + b + c for a in ("pre", "con", "re") for b in ("", "ver", "form") for c in ("s", "ing", "ed")})
    automaton = spelling.Automaton(words)
    assert [automaton._exact(0, 0, w) for w in words] == list(range(len(words)))
    states, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in states:
            states.add(s)
            todo.extend(t for t, _ in automaton.steps[s].values())
    suffixes = {frozenset(w[i:] for w in words if w.startswith(p)) for x in words for i in range(len(x) + 1) for p in [x[:i]]}
    assert len(states) == len(suffixes)
