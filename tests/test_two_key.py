"""Two-key dedupe against the in-order fold, on rows that share addresses and titles."""

import random

import pytest

from stepwell.operators import sequence

SCHEMA = "id long, address string, title string, abstract string, host string"


def fold(rows):
    by_a, by_b, out = {}, set(), []
    for i, a, b, abstract, host in sorted(rows):
        if a and a in by_a:
            base = by_a[a]
            base[1] = base[1] or abstract
            base[2] = base[2] | {host}
            continue
        if (b or "") in by_b:
            continue
        out.append([i, abstract, {host}])
        by_b.add(b or "")
        if a:
            by_a[a] = out[-1]
    return [(i, x or "", sorted(h)) for i, x, h in out]


#: one address under different titles; then a row that shares the address of a dropped row only
CHAIN = [(1, "u", "t", "", "h1"), (2, "u", "s", "text", "h2"), (3, "v", "t", "x", "h3"), (4, "v", "w", "", "h4"), (5, "", "s", None, "h5"), (6, None, "", "", "h6"), (7, "", None, "y", "h7")]


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_two_key_dedupe(spark, seed):
    rng = random.Random(seed)
    rows = CHAIN
    if seed is not None:
        pick = lambda n: rng.choice(["", None, *(f"k{i}" for i in range(n))])
        rows = [(i, pick(25), pick(25), rng.choice(["", None, f"a{i}"]), f"h{i % 7}") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sequence.two_key_dedupe(df, "id", "address", "title", "abstract", "host").collect()
    assert sorted((r.id, r.abstract or "", list(r.sources)) for r in got) == fold(rows)


def matching(rows):
    held, out = set(), []
    for at, a, b in sorted(rows):
        if (a is None or ("a", a) not in held) and ("b", b) not in held:
            out.append(at)
            held |= {("b", b)} | ({("a", a)} if a is not None else set())
    return out


def kept_of(spark, rows):
    kept, rounds = sequence.first_matching(spark.createDataFrame(rows, "_at long, _a string, _b string"))
    return sorted(r._at for r in kept.collect()), rounds


def test_chain_of_10000_keys_takes_one_round(spark):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(10_000)]
    assert kept_of(spark, rows) == (list(range(0, 10_000, 2)), 1)


def test_hot_keys_and_trees(spark):
    """A third of the rows share one key, some share both; orders run with and against the chains."""
    rng = random.Random(5)
    keys = [("hot" if i % 3 == 0 else f"a{rng.randrange(60)}" if i % 3 == 1 else None, f"b{rng.randrange(200)}") for i in range(900)]
    keys += [("x", "y")] * 3 + [(f"c{i // 2}", f"d{(i + 1) // 2}") for i in reversed(range(101))]
    rows = [(i, a, b) for i, (a, b) in enumerate(keys)]
    got, rounds = kept_of(spark, rows)
    assert got == matching(rows)
    assert rounds <= 12


def test_no_rows(spark):
    assert kept_of(spark, []) == ([], 0)
