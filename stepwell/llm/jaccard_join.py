"""Exact Jaccard self-join of shingle sets in their metric space.

1 - Jaccard is a metric.  Some sampled sets are pivots, each with a radius R; a set within R
of pivots lives in the Voronoi region of the nearest of these.  With r the radius of the join, a
set y can only be linked to a member of region p if d(y, p) <= R(p) + r and, where y lies R(q) - r
or less from a pivot q, if d(y, p) <= d(y, q) + 2r (triangle inequality), so boundary sets are
replicated to just those regions.  In a group of near copies all may lie at the boundary of all
pivots drawn from it.  So pivots are taken by what they gain, and a set is only one if at most
``CROWD`` times as many sampled sets lie within R + r of it as find their region with it: the
copies made do not grow with the number of pivots that a group has in the sample.

Most sets of a corpus are at a distance of nearly 1 from all others, where no window prunes.
Their pivots are single shingles: a set's distance to {s} is under 1 only if it holds s, its
nearest pivot is its rarest shingle, and a linked set shares one of the first
n - ceil(J n) + 1 shingles in an order common to all (this is a prefix filter).

Regions of few sets are joined by candidate pairs: sizes, places of the shared shingle and the
distances to the pivot must leave room for a link, and so must sketches: counts of a set's
shingles by hash, whose differences never add up to more than the sets' own difference.  Only
the sets of pairs that are left are sent to be compared.

In a large region sub-pivots are drawn, all sets within r of one are linked to it, and
components are taken; only pairs between components are looked for from there on.  Around a
pivot p a set x is known by its difference D(x) from p: x and y differ by as much as D(x) and
D(y) do.  Sets within r of p are linked to it.  Of any other pair that is linked, the
differences share an element, and in an order from rare to common the first one shared stands
at places i and j with i + j <= t, the most by which linked sets of their sizes differ (less
by as much as what follows differs in number).  So each set is posted under its first t + 1 elements, and only postings up to t / 2, or those
outside the main component of their element if they are fewer, ask the others.  Pairs of which
neither needs a shared element lie next to the ball, and are asked for there.  A large region of a shingle has no pivot near all its sets: those outside its
main component are compared, in blocks, with the region.  No link between different
components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import shingles, textbuf
from stepwell.llm.common import MAX_KEYS, checked_broadcast, discard, documents, materialise
from stepwell.llm.components import connected_components

WIDTH = 3
#: Similarity as a fraction.
JACCARD = (9, 10)
#: Sets drawn as pivots and their largest size; largest radius of a region, and sets that it may touch for each that it gains.
PIVOTS, PIVOT_SIZE, INSIDE, CROWD = 1024, 4096, 0.35, 3
#: Rows of a region of a pivot, and of a shingle, that is joined by pairs; sub-pivots of larger ones.
LARGE, CELL, SUB_PIVOTS = 64, 256, 16
#: Sets of a region that meet a block, and sets (and shingles) of a block.
CHUNK, BLOCK, BLOCK_SHINGLES = 128, 256, 1 << 17
#: Room for rounding in comparisons of distances.
SLACK = 1e-9


class Table:
    """Sorted shingles of a few sets, each with the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), n)
        h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h, self.owner = h[order], owner[order]
        self.tokens, self.first = np.unique(h, return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.sizes = n
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.tokens & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def shared(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, set, shingles shared) of all rows that share one with a set."""
        maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) == 0 or len(self.tokens) == 0:
            none = np.zeros(0, np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.tokens, h[maybe]), len(self.tokens) - 1)
        hit = self.tokens[at] == h[maybe]
        at, row = at[hit], row[maybe[hit]]
        n = self.count[at]
        start = np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        key = np.repeat(row, n) * len(self.sizes) + self.owner[start + np.arange(len(start))]
        key, shared = np.unique(key, return_counts=True)
        return key // len(self.sizes), key % len(self.sizes), shared


def chosen(sets: list[np.ndarray], r: float) -> tuple[list[int], np.ndarray]:
    """Places of the sets that become pivots, and their radii."""
    table, d = Table(sets), np.ones((len(sets), len(sets)))
    for lo in range(0, len(sets), 64):
        part = sets[lo : lo + 64]
        row = np.repeat(np.arange(lo, lo + len(part)), [len(s) for s in part])
        a, b, k = table.shared(row, np.concatenate(part))
        d[a, b] = 1 - k / (table.sizes[a] + table.sizes[b] - k)
    taken, radii = [], []
    homeless = np.ones(len(sets), bool)
    radius = INSIDE
    while radius > 0:
        inside, touched = d <= radius, (d <= radius + r).sum(axis=1)
        gain = (inside & homeless).sum(axis=1)
        while True:
            # a smaller region is for several sets: one alone is no crowd
            good = (gain >= (1 if radius == INSIDE else 2)) & (touched <= CROWD * gain)
            if not good.any():
                break
            x = int(np.argmax(np.where(good, gain, 0)))
            taken.append(x)
            radii.append(radius)
            new = inside[x] & homeless
            gain -= inside[:, new].sum(axis=1)
            homeless &= ~new
        radius -= r
    return taken, np.array(radii)


def _marks(width: int):
    """doc_id, uid, sid, n and the sketch: how many shingles fall into each of 64 or about n/16 bins, 255 at most."""

    def make(batch: pa.RecordBatch, lo: int, hi: int):
        row, h, size, sid = shingles.shingle_sets(batch.column("text"), lo, hi, width)
        bins = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 16) / 16)).astype(np.int64))
        ends = np.cumsum(bins)
        at = (ends - bins)[row] + (h & (bins[row] - 1).astype(np.uint64)).astype(np.int64)
        counts = np.minimum(np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0), 255).astype(np.uint8)
        sketch = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(counts)])
        ids = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "uid")]
        return [*ids, shingles.as_long(sid), pa.array(size.astype(np.int64)), sketch]

    return make


def _room(a: bytes, others: list[bytes], n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of sketches, those that leave room for a link with sketch a; n: sizes of both sets together."""
    keep = np.ones(len(others), bool)
    x = np.frombuffer(a, np.uint8).astype(np.int64)
    for length in {len(o) for o in others}:
        rows = [i for i, o in enumerate(others) if len(o) == length]
        b = np.frombuffer(b"".join(others[i] for i in rows), np.uint8).reshape(len(rows), length)
        full = (b == 255).any(axis=1) | (x == 255).any()  # such counts may be larger
        low = min(len(x), length)  # bins of the longer sketch fall into those of the shorter
        diff = np.abs(b.astype(np.int64).reshape(len(rows), -1, low).sum(axis=1) - x.reshape(-1, low).sum(axis=0)).sum(axis=1)
        keep[rows] = full | ((den + num) * diff <= (den - num) * n[rows])
    return keep


def _seen(h: np.ndarray, common) -> np.ndarray:
    """How often shingles are seen in the sample; 0 if rare."""
    tokens, counts = common.value
    if len(tokens) == 0 or len(h) == 0:
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
    return np.where(tokens[at] == h, counts[at], 0)


def _regions(width: int, pivots, common, num: int, den: int):
    """Rows (region, sid, n, pos, d, home): Voronoi regions with windows, shingle regions outside."""
    r = 1 - num / den

    def make(batch: pa.RecordBatch, lo: int, hi: int):
        row, h, size, sid = shingles.shingle_sets(batch.column("text"), lo, hi, width)
        table, names, _, radii = pivots.value
        out = []
        housed = np.zeros(hi - lo, bool)
        if len(names):
            a, p, k = table.shared(row, h)
            d = 1 - k / (size[a] + table.sizes[p] - k)
            inside = d <= radii[p]
            order = np.lexsort((p, d, ~inside, a))
            a, p, d, inside = a[order], p[order], d[order], inside[order]
            home = inside & np.r_[True, a[1:] != a[:-1]][: len(a)]
            housed[a[home]] = True
            deep = d + r + SLACK <= radii[p]  # all that is linked to such a set is within the radius too
            nearest = np.ones(hi - lo)
            np.minimum.at(nearest, a[deep], d[deep])
            keep = home | (d <= np.minimum(radii[p] + r, nearest[a] + 2 * r) + SLACK)
            a, p, d, home = a[keep], p[keep], d[keep], home[keep]
            out.append((names[p], a, np.zeros(len(a), np.int64), d, home))
        order = np.lexsort((h, _seen(h, common), row))
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        keep = (pos < (size - -(-num * size // den) + 1)[row]) & ~housed[row]
        a = row[keep]
        out.append((h[order][keep].view(np.int64), a, pos[keep], np.zeros(len(a)), np.ones(len(a), bool)))
        region, a, pos, d, home = (np.concatenate(x) for x in zip(*out))
        return [pa.array(region), shingles.as_long(sid[a]), pa.array(size[a].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(d), pa.array(home)]

    return make


def _unique(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    got = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])


def _pairs(num: int, den: int):
    """Rows sorted by region -> candidate pairs (a, b) of different roots; regions are small."""
    r = 1 - num / den

    def room(n, at, m, to):
        return (num + den) * np.minimum(n - at, m - to) >= num * (n + m)

    def pairs(k, sid, n, pos, d, home, root, sketch):
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        a, b = [], []
        for lo, hi in zip(first.tolist(), np.append(first[1:], len(k)).tolist()):
            for i in range(lo, hi - 1):
                j = np.arange(i + 1, hi)
                j = j[(home[j] | home[i]) & (root[j] != root[i]) & (np.abs(d[j] - d[i]) <= r + SLACK) & room(n[i], pos[i], n[j], pos[j])]
                if len(j):
                    j = j[_room(sketch[i], [sketch[x] for x in j.tolist()], n[i] + n[j], num, den)]
                    a.append(sid[j])
                    b.append(np.full(len(j), sid[i]))
        return _unique(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "sid", "n", "pos", "d", "home", "root", "sketch")]
            now[2:4] = [x.astype(np.int64) for x in now[2:4]]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if len(now[0]) == 0:
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last region may go on
            if cut:
                yield pairs(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield pairs(*held)

    return run


def _lead_pairs(num: int, den: int):
    """Rows (part, lead, sid, root, n, nd, pos, home) sorted by part, leads first -> pairs of a lead and another row."""
    names = ("sid", "root", "n", "nd", "pos", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leads = None, None
        for batch in batches:
            parts, lead = batch.column("part").to_numpy(), batch.column("lead").to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            cuts = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (lead[1:] != lead[:-1])]) if len(parts) else []
            a, b = [], []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(parts))):
                if parts[lo] != part:
                    part, leads = parts[lo], np.zeros((len(names), 0), np.int64)
                if lead[lo]:
                    leads = np.concatenate([leads, rows[:, lo:hi]], axis=1)
                    continue
                sid, root, n, nd, pos, home = rows[:, lo:hi]
                for x in range(0, leads.shape[1], 1024):
                    lsid, lroot, ln, lnd, lpos, lhome = (c[:, None] for c in leads[:, x : x + 1024])
                    most = (den - num) * (n + ln)
                    good = (lroot != root) & (lsid != sid) & (lhome + home > 0)
                    # neither what comes before the shared element nor the surplus of what follows is shared
                    good &= (den + num) * (pos + lpos + np.abs((nd - pos) - (lnd - lpos))) <= most
                    good &= num * np.maximum(n, ln) <= den * np.minimum(n, ln)
                    i, j = np.nonzero(good)
                    a.append(lsid[i, 0])
                    b.append(sid[j])
            yield _unique(a, b)

    return run


def _meet(num: int, den: int):
    """Rows sorted by (part, lead first): every other row of a part against its leads -> links.

    Only the leads of one part are held; the others stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leads, sets, table = None, [], [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            lead = batch.column("lead").to_numpy(zero_copy_only=False)
            sid = batch.column("sid").to_numpy()
            lists = batch.column("h")
            offsets = lists.offsets.to_numpy()
            offsets, flat = offsets - offsets[0], lists.flatten().to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (lead[1:] != lead[:-1])]) if len(parts) else []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(parts))):
                if parts[lo] != part:
                    part, leads, sets, table = parts[lo], [], [], None
                if lead[lo]:
                    leads.extend(sid[lo:hi].tolist())
                    sets.extend(flat[offsets[i] : offsets[i + 1]].copy() for i in range(lo, hi))
                    continue
                if not leads:
                    continue
                table = table or Table(sets)
                n = np.diff(offsets[lo : hi + 1])
                row, p, k = table.shared(np.repeat(np.arange(hi - lo), n), flat[offsets[lo] : offsets[hi]])
                a, b = sid[lo:hi][row], np.array(leads)[p]
                near = ((num + den) * k >= num * (n[row] + table.sizes[p])) & (a != b)
                yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])

    return run


def _links(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of rows (part, lead, sid), whose leads come first in each part."""
    whole = rows.join(sets, "sid").select("part", "lead", "sid", "h")
    dealt = whole.repartition("part").sortWithinPartitions("part", F.desc("lead"))
    return materialise(dealt.mapInArrow(_meet(num, den), "a long, b long").distinct(), "links")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, rows["sid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sid")).drop("node")


def _sub_pivots(large: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the sets of large regions with some of their own region (rows with c, its rows)."""
    chunks = F.ceil(F.col("c") / CHUNK).cast("int")
    drawn = F.pmod(F.xxhash64("sid", "region"), "c") < SUB_PIVOTS
    others = large.select(F.xxhash64("region", F.pmod(F.xxhash64("sid"), chunks).cast("int")).alias("part"), F.lit(False).alias("lead"), "sid")
    leads = large.filter(drawn).select("region", "sid", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    leads = leads.select(F.xxhash64("region", F.col("chunk").cast("int")).alias("part"), F.lit(True).alias("lead"), "sid")
    return _links(others.union(leads), sets, num, den)


def _blocks(large: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of large regions: those outside the main one, in blocks, with all."""
    sizes = materialise(large.groupBy("region", "root").agg(F.count("*").alias("m"), F.sum("n").alias("w")), "sizes")
    total = sizes.groupBy("region").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("c"), F.max("m").alias("top"), F.sum("w").alias("w"), F.max_by("w", F.struct("m", "root")).alias("topw"))
    blocks = F.greatest(F.ceil((F.col("c") - F.col("top")) / BLOCK), F.ceil((F.col("w") - F.col("topw")) / BLOCK_SHINGLES)).cast("int")
    open_ = total.filter("c > top").select("region", "main", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks"), blocks.alias("blocks"))
    rows = large.select("region", "sid", "root").join(materialise(open_, "open"), "region")
    block, chunk = F.pmod(F.xxhash64("sid"), "blocks"), F.pmod(F.xxhash64("sid", F.lit(1)), "chunks")
    leads = rows.filter("root <> main").select("region", "sid", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    others = rows.select("region", "sid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"))
    part = F.xxhash64("region", F.col("block").cast("int"), F.col("chunk").cast("int")).alias("part")
    both = others.select(part, F.lit(False).alias("lead"), "sid").union(leads.select(part, F.lit(True).alias("lead"), "sid"))
    return _links(both, sets, num, den)


def _differences(pivots, common, num: int, den: int):
    """(region, sid, n, home, c, h) -> (region, sid, n, home, np, nd, posted).

    np and nd are the sizes of the region's pivot and of what a set doesn't share with it;
    posted are the elements of that which a linked set may be known by, from rare to common.
    A shingle of the pivot is an element of the sets of the region, c in all, that lack it.
    """

    def differ(rows: pa.RecordBatch, own: dict[int, np.ndarray]) -> pa.RecordBatch:
        sizes, found, lacked = [], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for region, h in zip(rows.column("region").to_pylist(), rows.column("h")):
            pivot = own[region]
            found.append(np.setxor1d(h.values.to_numpy().view(np.uint64), pivot, assume_unique=True))
            lacked.append(np.isin(found[-1], pivot, assume_unique=True))
            sizes.append((len(pivot), len(found[-1])))
        of_pivot, size = np.array(sizes, np.int64).reshape(-1, 2).T
        diff, row = np.concatenate(found), np.repeat(np.arange(len(size)), size)
        seen = _seen(diff, common)
        without = np.maximum(rows.column("c").to_numpy()[row] // shingles.SAMPLE - seen, 0)
        diff = diff[np.lexsort((diff, np.where(np.concatenate(lacked), without, seen), row))]
        most = rows.column("n").to_numpy().astype(np.int64) * (den - num) // num
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        offsets = pa.array(np.append(0, np.cumsum(np.minimum(size, most + 1))).astype(np.int32))
        posted = pa.ListArray.from_arrays(offsets, shingles.as_long(diff[pos <= most[row]]))
        names = ["region", "sid", "n", "home"]
        return pa.RecordBatch.from_arrays([*map(rows.column, names), pa.array(of_pivot), pa.array(size), posted], [*names, "np", "nd", "posted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {int(name): np.sort(s) for name, s in zip(pivots.value[1].tolist(), pivots.value[2])}
        for batch in batches:
            starts, lo = batch.column("h").offsets.to_numpy(), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK_SHINGLES, side="right")) - 1)
                yield differ(batch.slice(lo, hi - lo), own)
                lo = hi

    return run


def _parted(rows: DataFrame, key: list[str], early) -> DataFrame:
    """Rows (*key, sid, root, n, nd, pos, home) as parts for `_lead_pairs`: leads go to every chunk of their key.

    Leads are the early rows, or those outside the key's main component if they are fewer.
    """
    marked = rows.withColumn("early", early)
    roots = marked.groupBy(*key, "root").agg(F.count("*").alias("m"), F.sum(F.col("early").cast("int")).alias("e"))
    sizes = roots.groupBy(*key).agg(F.sum("m").alias("c"), F.sum("e").alias("e"), F.max("m").alias("top"), F.max_by("root", F.struct("m", "root")).alias("main"))
    few = F.col("c") - F.col("top")  # a key of one component has none
    chunks = F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks")
    sizes = sizes.filter((few > 0) & (F.col("e") > 0)).select(*key, chunks, "main", (few < F.col("e")).alias("by_root"))
    marked = marked.join(materialise(sizes, "cells"), key)
    part = F.xxhash64(*key, "chunk").alias("part")
    columns = ["sid", "root", "n", "nd", "pos", "home"]
    others = marked.withColumn("chunk", F.pmod(F.xxhash64("sid"), "chunks").cast("int")).select(part, F.lit(False).alias("lead"), *columns)
    asks = F.when(F.col("by_root"), F.col("root") != F.col("main")).otherwise(F.col("early"))
    leads = marked.filter(asks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return others.union(leads.select(part, F.lit(True).alias("lead"), *columns))


def _around_pivots(large: DataFrame, sets: DataFrame, pivots, common, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large regions of pivots -> their differences, with whether they lie in the pivot's ball, and links with the pivots."""
    whole = large.select("region", "sid", "n", "home", "c").join(sets, "sid").select("region", "sid", "n", "home", "c", "h")
    schema = "region long, sid long, n int, home boolean, np long, nd long, posted array<long>"
    diffs = whole.mapInArrow(_differences(pivots, common, num, den), schema)
    inside = (den + num) * F.col("nd") <= (den - num) * (F.col("n") + F.col("np"))
    diffs = materialise(diffs.withColumn("ball", inside), "diffs")
    return diffs, diffs.filter("ball AND nd > 0").select(F.col("sid").alias("a"), F.col("region").alias("b"))


def _posted_pairs(diffs: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of sets of different components by their differences (with roots)."""
    most = F.floor(F.col("n") * (den - num) / num)
    columns = ["sid", "root", "n", "nd", "pos", "home"]
    posted = diffs.select("region", "sid", "root", "n", "nd", "home", F.posexplode("posted").alias("pos", "token"))
    posted = materialise(posted.select("region", "token", *columns), "posted")
    parts = _parted(posted, ["region", "token"], F.col("pos") * 2 <= most)
    # no shared element is needed where both differences together are t at most
    core = diffs.filter(F.col("nd") <= most).withColumn("pos", F.col("nd")).select("region", *columns, "ball")
    parts = parts.union(_parted(core, ["region"], ~F.col("ball")))
    dealt = parts.repartition("part").sortWithinPartitions("part", F.desc("lead"))
    return materialise(dealt.mapInArrow(_lead_pairs(num, den), "a long, b long").distinct(), "pairs")


def _pivots(one: DataFrame, reps: DataFrame, width: int, r: float):
    """The pivots' table, names, sets and radii, on all executors."""
    spark = one.sparkSession
    drawn = reps.filter(F.col("n").between(1, PIVOT_SIZE)).orderBy(F.xxhash64("sid", F.lit(7)), "sid").limit(PIVOTS).select("uid")
    found = shingles.mapped(one.join(F.broadcast(drawn), "uid", "left_semi"), shingles.whole(width), "sid long, h array<long>")
    rows = found.dropDuplicates(["sid"]).orderBy(F.xxhash64("sid", F.lit(7)), "sid").toArrow()  # no Python object for a shingle
    sets = [h.values.to_numpy().view(np.uint64) for h in rows["h"]]
    taken, radii = chosen(sets, r)
    sets = [sets[i].copy() for i in taken]
    return spark.sparkContext.broadcast((Table(sets), rows["sid"].to_numpy()[taken], sets, radii))


def _common(one: DataFrame, width: int):
    """Sorted shingles that are common in the sample, and their counts, on all executors."""
    seen = shingles.mapped(one, shingles.sampled(width), "token long").groupBy("token").count()
    top = seen.filter(F.col("count") >= shingles.COMMON).orderBy(F.desc("count"), "token").limit(shingles.MAX_COMMON).toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return one.sparkSession.sparkContext.broadcast((tokens[order], top["count"].to_numpy()[order]))


def _of_distinct(docs: DataFrame, known: DataFrame, reps: DataFrame) -> DataFrame:
    """Documents without copies, where that costs no shuffle of texts: a copy makes the same rows again.

    The fewer keys are broadcast: those that stay, or those that go (copies and wordless texts).
    """
    stay = reps.select("uid")
    go = materialise(known.select("uid").distinct().join(stay, "uid", "left_anti"), "copies")
    n, m = go.count(), stay.count()
    if min(n, m) > MAX_KEYS:
        return docs
    return docs.join(F.broadcast(go), "uid", "left_anti") if n <= m else docs.join(F.broadcast(stay), "uid", "left_semi")


def links(
    docs: DataFrame, width: int = WIDTH, jaccard: tuple[int, int] = JACCARD, ahead: Callable[[DataFrame, DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """known (doc_id, uid, sid, n, sketch), reps (sid, least, uid, n, sketch) and links (a, b) between sets.

    docs as `documents` gives them.  The links join up all pairs of sets with a similarity of
    ``jaccard`` or more; each of them is such a pair.  ``ahead(docs, reps)`` gives candidate
    pairs (a, b) that another method has found: they are compared first, and regions are
    only searched for links between the components that they make.
    """
    num, den = jaccard
    spark = docs.sparkSession
    known = materialise(shingles.mapped(docs, _marks(width), "doc_id long, uid long, sid long, n long, sketch binary"), "known")
    firsts = [F.min("doc_id").alias("least"), F.min("uid").alias("uid"), F.first("n").alias("n")]
    reps = known.filter("n > 0").groupBy("sid").agg(*firsts, F.first("sketch").alias("sketch"))
    reps = materialise(reps, "reps")
    one = _of_distinct(docs, known, reps)

    def whole(pairs: DataFrame, more: DataFrame | None = None) -> DataFrame:
        need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))
        need = (need if more is None else need.union(more.select("sid"))).distinct()
        uids = checked_broadcast(materialise(reps.join(need, "sid").select("uid"), "uids"))
        sets = shingles.mapped(one.join(uids, "uid", "left_semi"), shingles.whole(width), "sid long, h array<long>")
        return materialise(sets.dropDuplicates(["sid"]), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("part"), F.lit(False).alias("lead"), F.col("b").alias("sid"))
        leads = pairs.select(F.col("a").alias("part"), F.lit(True).alias("lead"), F.col("a").alias("sid")).distinct()
        return _links(asked.union(leads), sets, num, den)

    first = None
    if ahead is not None:
        asked = materialise(ahead(one, reps), "ahead")
        sets = whole(asked)
        first = confirmed(asked, sets)
        discard(sets)
        known_roots = materialise(connected_components(first, "a", "b"), "roots")
    pivots = _pivots(one, reps, width, 1 - num / den)
    common = _common(one, width)
    textbuf.release()  # on the driver too
    schema = "region long, sid long, n int, pos int, d double, home boolean"
    placed = materialise(shingles.mapped(one, _regions(width, pivots, common, num, den), schema), "placed")
    rooted = placed.withColumn("root", F.col("sid")) if first is None else materialise(_rooted(placed, known_roots), "rooted")
    several = rooted.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("home").alias("any"))
    several = materialise(several.filter("x < y AND any").select("region"), "several")
    rows = materialise(rooted.join(several, "region").distinct(), "rows")
    discard(placed)
    if first is not None:
        discard(rooted)
    counts = materialise(rows.groupBy("region").agg(F.count("*").alias("c")), "counts")
    rows = rows.join(counts, "region")
    names = F.broadcast(spark.createDataFrame([(int(x), LARGE) for x in pivots.value[1]], "region long, most int"))  # PIVOTS rows at most
    rows = materialise(rows.join(names, "region", "left").withColumn("by_pivot", F.col("most").isNotNull()), "counted")
    fits = F.col("c") <= F.coalesce("most", F.lit(CELL))
    small, large = rows.filter(fits), rows.filter(~fits)
    by_pairs = small.join(reps.select("sid", "sketch"), "sid").select("region", "sid", "n", "pos", "d", "home", "root", "sketch")
    by_pairs = by_pairs.repartition("region").sortWithinPartitions("region")
    pairs = materialise(by_pairs.mapInArrow(_pairs(num, den), "a long, b long").distinct(), "pairs")
    large = large.drop("root")
    sets = whole(pairs, large)
    found = confirmed(pairs, sets)
    if first is not None:
        found = found.union(first)
    if large.take(1):
        diffs, ball = _around_pivots(large.filter("by_pivot"), sets, pivots, common, num, den)
        found = materialise(found.union(ball).union(_sub_pivots(large, sets, num, den)).distinct(), "found")
        roots = materialise(connected_components(found, "a", "b"), "roots")
        rooted = materialise(_rooted(diffs, roots), "rooted")
        several = rooted.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("region")
        found = found.union(confirmed(_posted_pairs(rooted.join(F.broadcast(several), "region"), num, den), sets))
        of_shingles = materialise(_rooted(large.filter("NOT by_pivot"), roots), "rooted")
        found = found.union(_blocks(of_shingles, sets, num, den))
    return known, reps, found


def join_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    jaccard: tuple[int, int] = JACCARD,
    ahead: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """doc_id, uid, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Words are runs of non-white-space with A-Z lower-cased; a text of fewer than ``width``
    words is one shingle; null and wordless texts have no shingle and no link, to each other
    neither.  Sets are compared by 64-bit hashes of their shingles.  ``ahead`` as in `links`.  Repeated rows give
    repeated rows.  A null doc_id is never the least unless no other is reachable.  Extra
    columns are ignored; the table may be empty.
    """
    known, reps, found = links(documents(docs, id_col, text_col), width, jaccard, ahead)
    roots = connected_components(found, "a", "b")
    named = reps.join(roots, reps["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    tops = named.groupBy("root").agg(F.min("least").alias("top"))
    named = named.join(tops, "root").select("sid", "top")
    component = F.when(F.col("n") > 0, F.coalesce("top", "doc_id")).otherwise(F.col("doc_id"))
    return known.join(named, "sid", "left").select("doc_id", "uid", F.col("n").alias("n_shingles"), component.alias("component_id"))
