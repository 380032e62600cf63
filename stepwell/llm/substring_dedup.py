"""Substring dedup: prefix-partitioned suffix trees over word sequences.

A repeat of ``window`` words is looked for below a prefix of ``gram`` words that both
copies hold at the same place: the least, by hash, of the window's gram prefixes (its
anchor).  Prefixes that only one document holds are leaves and are cut off.  Around
every other anchor the words of its windows, a branch, go to the group of the prefix.
A group of up to GROUP branches is built as a tree in a task: its suffixes are ranked
by word, 2 words, 4 words ... up to ``window`` words, and suffixes of equal last rank
lie under one internal node of that depth.  A prefix that more branches share is
lengthened to the whole window, where a node needs only its least document, an
aggregate, so no group is larger than a task can hold and none is gathered whole
however often a passage occurs.  A node with an earlier document marks repeats; runs
of marked suffixes are the maximal repeats.

Inside groups words are compared by their bytes, lengthened prefixes by two independent
64-bit hashes (at 1e13 windows the chance of one false match is 1e-12).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import textbuf
from stepwell.llm.common import MAX_KEYS, discard, documents, materialise


#: Branches of one prefix that are built as a tree, of about 500 bytes each: 8 MB of text
#: and some 150 MB of ranks.  Beyond it the prefix is lengthened.
GROUP = 1 << 14
#: Values of bytes for a second, independent hash of words.
_OTHER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _slide(h: np.ndarray, n: int, best) -> np.ndarray:
    """Least or greatest of every n consecutive entries, by doubling."""
    size = 1
    while 2 * size <= n:
        h = best(h[: len(h) - size], h[size:])
        size *= 2
    rest = n - size
    return best(h[: len(h) - rest], h[rest:]) if rest else h


def _rows(column: pa.Array, lo: int, hi: int):
    """Words of rows lo..hi: buffer, starts, ends, hashes, the row and first word of each row."""
    buf, row_start, row_end = textbuf.buffer(column, lo, hi)
    starts, ends, hashes = textbuf.word_hashes(buf)
    first = np.searchsorted(starts, row_start)
    n = np.diff(np.append(first, len(starts)))
    return buf, row_start, row_end, starts, ends, hashes, first, n


def sampled(hashes: np.ndarray, row: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Word indexes of sampled grams; rows of fewer than ``window`` words give none."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    g = textbuf.grams(hashes, gram)
    span = window - gram + 1
    least = _slide(g, span, np.minimum)  # least[j]: window starting at word j
    inside = row[: len(least)] == row[window - 1 : window - 1 + len(least)]
    least = np.where(inside, least, np.uint64(0))
    edge = np.zeros(span - 1, np.uint64)
    top = _slide(np.concatenate([edge, least, edge]), span, np.maximum)  # over windows that hold gram i
    return np.flatnonzero((top[: len(g)] == g) & (top[: len(g)] != 0))


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            ids, uids = batch.column("doc_id"), batch.column("uid")
            for lo, hi in textbuf.slices(text):
                *_, hashes, first, n = _rows(text, lo, hi)
                row = np.repeat(np.arange(lo, hi), n)
                at = sampled(hashes, row, window, gram)
                g = textbuf.grams(hashes, gram)[at] if len(at) else np.zeros(0, np.uint64)
                r = row[at]
                pos = (at - first[r - lo]).astype(np.int32)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), ids.take(take), uids.take(take), pa.array(pos)], ["gram", "doc_id", "uid", "pos"]
                )

    return run


def _pieces(total: np.ndarray, most: int = textbuf.BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of entries of at most ``most`` bytes (one entry at least); total counts the bytes before each."""
    lo, n = 0, len(total) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi


def _branches(window: int, gram: int):
    """Rows with ``near``, the places of shared anchors -> a branch per anchor that is some window's least.

    A window belongs to its leftmost least gram, which its words alone decide.  A branch
    holds the words of its windows, which follow each other; n is their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = window - gram + 1
        for batch in batches:
            text, near = batch.column("text"), batch.column("near")
            ids, uids = batch.column("doc_id"), batch.column("uid")
            for lo, hi in textbuf.slices(text):
                buf, row_start, row_end, starts, ends, hashes, first, n = _rows(text, lo, hi)
                if len(hashes) < window:
                    continue
                part = near.slice(lo, hi - lo)
                anchor = part.flatten().field("pos").to_numpy() + np.repeat(first, part.value_lengths().to_numpy())
                hot = part.flatten().field("hot").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(hi - lo), n)
                g = textbuf.grams(hashes, gram)
                least = _slide(g, span, np.minimum)
                here = g[anchor]
                low = np.maximum(anchor - span + 1, first[row[anchor]])
                before = np.r_[-1, anchor[:-1]]
                same = np.r_[False, (here[1:] == here[:-1]) & (row[anchor[1:]] == row[anchor[:-1]])]
                low = np.where(same, np.maximum(low, before + 1), low)
                top = np.minimum(anchor, first[row[anchor]] + n[row[anchor]] - window)
                size = np.maximum(top - low + 1, 0)
                which = np.repeat(np.arange(len(anchor)), size)
                at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
                own = least[at] == here[which]
                which, at = which[own], at[own]
                # an equal gram further left, with others between, takes the window
                last = np.full(len(least), -1, np.int64)
                last[at[::-1]] = which[::-1]
                own = last[at] == which
                which, at = which[own], at[own]
                edge = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
                count = np.diff(np.append(edge, len(at)))
                begin = at[edge]
                r = row[begin]
                a, b = starts[begin], ends[begin + window + count - 2]
                total = np.concatenate([[0], np.cumsum(b - a)])
                for i, j in _pieces(total):
                    offsets = total[i : j + 1] - total[i]
                    data = buf[np.repeat(a[i:j] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])].tobytes()
                    anchors, take = which[edge[i:j]], pa.array(r[i:j] + lo)
                    columns = [
                        pa.array(here[anchors].view(np.int64)), pa.array(hot[anchors]), ids.take(take), uids.take(take),
                        pa.array((begin[i:j] - first[r[i:j]]).astype(np.int32)), pa.array(count[i:j].astype(np.int32)),
                        pa.StringArray.from_buffers(j - i, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "hot", "doc_id", "uid", "pos", "n", "text"])

    return run


BRANCH = "gram long, hot boolean, doc_id long, uid long, pos int, n int, text string"


def exact_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of words, equal for words of equal bytes and for no others.

    Words of one hash are held against the first of them, eight bytes at a time; a hash
    that stands for different words is told apart one by one.
    """
    _, head, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size, twin = ends - starts, head[ids]
    bad = size != size[twin]
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    left = np.flatnonzero(~bad & (twin != np.arange(len(twin))))
    at = 0
    while len(left):
        a, b = starts[left] + at, starts[twin[left]] + at
        rest = np.minimum(size[left] - at, 8)
        differs = np.zeros(len(left), bool)
        for j in range(8):
            differs |= (j < rest) & (wide[a + j] != wide[b + j])
        bad[left[differs]] = True
        at += 8
        left = left[~differs & (size[left] > at)]
    if bad.any():
        ids, fresh = ids.copy(), {}
        clash = np.isin(ids, ids[bad])
        base = int(ids.max()) + 1
        for i in np.flatnonzero(clash).tolist():
            ids[i] = base + fresh.setdefault(buf[starts[i] : ends[i]].tobytes(), len(fresh))
    return ids


def node_ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``window`` words, by doubling; ids must keep groups apart."""
    rank, depth = ids.astype(np.int64), 1
    while depth < window:
        shift = min(depth, window - depth)
        n = len(rank) - shift
        key = rank[:n] * (int(rank.max(initial=0)) + 1) + rank[shift:]
        rank, depth = np.unique(key, return_inverse=True)[1].ravel(), depth + shift
    return rank


def _trees(window: int, most: int = 2 * textbuf.BLOCK):
    """Branches sorted by gram -> (uid, start, stop): runs of suffixes whose deep node has an earlier document."""
    names = ("gram", "doc_id", "uid", "pos", "n", "text")

    def build(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        doc, uid, pos, n = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("doc_id", "uid", "pos", "n"))
        buf, row_start, _ = textbuf.buffer(pa.concat_arrays([p.column("text") for p in parts]), 0, len(doc))
        starts, ends, hashes = textbuf.word_hashes(buf)
        first = np.searchsorted(starts, row_start)
        rank = node_ranks(exact_ids(buf, starts, ends, hashes), window)
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        node = rank[first[owner] + inner]
        least = np.full(int(rank.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[owner])
        marked = doc[owner] > least[node]
        owner, place = owner[marked], (pos[owner] + inner)[marked]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
        edge = np.flatnonzero(fresh)
        stop = place[np.append(edge, len(place))[1:] - 1] + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(uid[owner[edge]]), pa.array(place[edge].astype(np.int32)), pa.array(stop.astype(np.int32))], ["uid", "start", "stop"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            batch = batch.select(names)
            for lo, hi in textbuf.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                gram = part.column("gram").to_numpy()
                size += part.column("text").nbytes
                cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
                goes_on = cut == 0 and held and held[-1].column("gram")[-1].as_py() == int(gram[-1])
                if size > most and not goes_on:
                    done = [*held, part.slice(0, cut)] if cut else held
                    if done:
                        yield build(done)
                    held, size = [part.slice(cut)], part.slice(cut).column("text").nbytes
                else:
                    held.append(part)
        if held:
            yield build(held)

    return run


def _windows(window: int):
    """Branches -> (h1, h2, doc_id, uid, pos) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textbuf.slices(batch.column("text")):
                buf, row_start, _ = textbuf.buffer(batch.column("text"), lo, hi)
                starts, _, hashes = textbuf.word_hashes(buf)
                other = textbuf.word_hashes(buf, _OTHER)[2]
                first = np.searchsorted(starts, row_start)
                n = batch.column("n").to_numpy()[lo:hi]
                owner = np.repeat(np.arange(hi - lo), n)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                at = first[owner] + inner
                take = pa.array(owner + lo)
                keys = [pa.array(textbuf.grams(h, window)[at].view(np.int64)) for h in (hashes, other)]
                pos = pa.array((batch.column("pos").to_numpy()[lo:hi][owner] + inner).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*keys, batch.column("doc_id").take(take), batch.column("uid").take(take), pos], ["h1", "h2", "doc_id", "uid", "pos"]
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column("text"), batch.column("runs")
            for lo, hi in textbuf.slices(text):
                buf, row_start, row_end = textbuf.buffer(text, lo, hi)
                starts, ends = textbuf.spans(buf)
                first = np.searchsorted(starts, row_start)
                n = np.diff(np.append(first, len(starts)))
                part = gone.slice(lo, hi - lo)
                sizes = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                runs, base = part.flatten(), np.repeat(first, sizes)
                mark = np.zeros(len(starts) + window + 1, np.int64)
                np.add.at(mark, runs.field("start").to_numpy() + base, 1)
                np.add.at(mark, runs.field("stop").to_numpy() + base + window - 1, -1)
                kept = np.cumsum(mark)[: len(starts)] == 0
                row = np.repeat(np.arange(hi - lo), n)
                n_kept = np.bincount(row[kept], minlength=hi - lo)
                ks, ke, kr = starts[kept], ends[kept], row[kept]
                buf[ke] = 32
                edge = np.zeros(len(buf) + 1, np.int8)
                edge[ks] += 1
                edge[ke + 1] -= 1
                keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
                last = np.append(kr[1:] != kr[:-1], True) if len(kr) else np.zeros(0, bool)
                keep[ke[last]] = False  # no space after a row's last word
                ends_at = np.concatenate([[0], np.cumsum(keep)])[np.append(row_end + 1, 0)]
                offsets = np.concatenate([[0], ends_at[:-1]]).astype(np.int32)
                data = buf[keep].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("uid").slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        pa.array((n - n_kept).astype(np.int64)),
                        pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)),
                    ],
                    ["doc_id", "uid", "n_words", "n_removed", "text"],
                )

    return run


def _order(c: str):
    """A null doc_id counts as the greatest long."""
    return F.coalesce(F.col(c), F.lit((1 << 63) - 1))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with more than one doc_id below: the least and the number of rows, as a table of its own.

    Joined from a table, both sides are dealt out for the join alone, so that the
    adaptive skew join may split the rows of a frequent node.
    """
    got = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows"))
    return materialise(got.filter("least < most").select(*keys, "least", "rows"), "nodes")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    gram: int = 10,
    group: int = GROUP,
) -> DataFrame:
    """doc_id, uid, n_words, n_removed, text (words left, joined by one space).

    A word goes if a run of ``window`` words that covers it also starts in a document
    with a smaller doc_id; all is judged on the input.  A null doc_id is larger than any
    other and equal to itself.  Rows with one doc_id never remove each other's words.
    Null and empty texts have no words.  Repeated rows stay repeated.  Extra columns are
    ignored; the table may be empty.
    """
    base = documents(docs, id_col, text_col)
    ordered = base.select(_order("doc_id").alias("doc_id"), "uid", "text")
    anchors = materialise(ordered.mapInArrow(_anchors(window, gram), "gram long, doc_id long, uid long, pos int"), "anchors")
    prefixes = _shared(anchors, ["gram"]).select("gram", (F.col("rows") > group).alias("hot"))
    near = F.array_sort(F.collect_set(F.struct("pos", "hot"))).alias("near")
    near = materialise(anchors.join(prefixes, "gram").groupBy("uid").agg(near), "near")
    discard(anchors)
    few = near.count() <= MAX_KEYS
    pick = F.broadcast(near.select("uid")) if few else near.select("uid")
    branches = ordered.join(pick, "uid", "left_semi").join(near, "uid").select("doc_id", "uid", "text", "near")
    branches = materialise(branches.mapInArrow(_branches(window, gram), BRANCH), "branches")
    groups = branches.filter("NOT hot").drop("hot").repartition("gram").sortWithinPartitions("gram")
    found = groups.mapInArrow(_trees(window), "uid long, start int, stop int")
    # prefixes lengthened to whole windows: nodes are aggregates
    suffixes = branches.filter("hot").drop("hot").mapInArrow(_windows(window), "h1 long, h2 long, doc_id long, uid long, pos int")
    suffixes = materialise(suffixes, "suffixes")
    deep = suffixes.join(_shared(suffixes, ["h1", "h2"]), ["h1", "h2"]).filter("doc_id > least")
    found = found.union(deep.select("uid", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop")))
    runs = materialise(found.groupBy("uid").agg(F.collect_set(F.struct("start", "stop")).alias("runs")), "runs")
    for table in (branches, suffixes, near):
        discard(table)
    out = "doc_id long, uid long, n_words long, n_removed long, text string"
    cols = ["doc_id", "uid", "text", "runs"]
    if few:
        pick = F.broadcast(runs.select("uid"))
        whole = base.join(pick, "uid", "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
        parts = base.join(pick, "uid", "left_semi").join(runs, "uid")
        return whole.select(*cols).mapInArrow(_cut(window), out).union(parts.select(*cols).mapInArrow(_cut(window), out))
    return base.join(runs, "uid", "left").select(*cols).mapInArrow(_cut(window), out)
