"""The trees of the substring dedup: lengthened prefixes, colliding hashes, branches across batches."""

from __future__ import annotations

import random

import numpy as np
import pytest

import brute
from stepwell.llm import substring_dedup, textbuf


def documents(seed: int):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(40, 140))] for _ in range(6)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += [rng.choice(words) for _ in range(rng.randrange(0, 60))]
            part = list(rng.choice(passages))
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "edit"
            text += part
        rows.append((d, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(100, "a " * 200), (101, "a " * 170 + "b"), (102, "a b " * 90), (103, "b a " * 70), (104, None), (105, "x" * 5000)]
    return rows


@pytest.mark.parametrize("group", [0, 20, substring_dedup.GROUP])
def test_groups_and_lengthened_prefixes(spark, group):
    rows = documents(group)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()
    want = {d: (n, gone, kept) for d, (n, gone, kept) in brute.repeats(rows).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == want


def test_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(5, passage), (5, passage), (5, passage + " tail"), (None, passage), (None, passage + " x"), (4, "y " + passage)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 60, 60), (-1, 61, 60), (4, 61, 0), (5, 60, 60), (5, 60, 60), (5, 61, 60)]


def test_words_of_one_hash_are_told_apart():
    words = ["one", "two", "one", "three", "onetwothree1", "onetwothree2", "onetwothree1", "six"]
    buf = np.frombuffer((" ".join(words) + "\n").encode(), np.uint8)
    starts, ends = textbuf.spans(buf)
    ids = substring_dedup.exact_ids(buf, starts, ends, np.zeros(len(words), np.uint64))
    assert [[a == b for b in ids] for a in ids] == [[a == b for b in words] for a in words]


def test_ranks_name_whole_windows():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2, 400)
    for window in (1, 2, 3, 7, 10):
        rank = substring_dedup.node_ranks(ids, window)
        seen = [tuple(ids[i : i + window]) for i in range(len(ids) - window + 1)]
        assert len(rank) == len(seen)
        name = {}
        assert all(name.setdefault(s, r) == r for s, r in zip(seen, rank.tolist())) and len(set(name.values())) == len(name)
