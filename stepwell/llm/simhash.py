"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints are linked at Hamming distance ``radius`` or less.  Every bit gets a
random vector of radius + 1 bits; the table of a non-zero vector v keeps the bits
whose vector has an odd inner product with v.  For any radius positions some v is
orthogonal to all their vectors, so every pair within the radius agrees on the kept
bits of some table: no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import textbuf
from stepwell.llm.common import checked_broadcast, documents, hex64, materialise, row_uid
from stepwell.llm.components import connected_components

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORDS = 1 << 16


def _signs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set bits per bit position and group; groups start at ``first``."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, first, axis=0, dtype=np.int64)


def fingerprints_of(column: pa.Array, lo: int, hi: int, width: int, seed: int) -> np.ndarray:
    buf, row_start, _ = textbuf.buffer(column, lo, hi)
    buf = _FOLD[buf]
    starts, ends = textbuf.spans(buf)
    first = np.searchsorted(starts, row_start)
    n = np.diff(np.append(first, len(starts)))
    out = np.zeros(hi - lo, np.uint64)
    # words joined by one space each: the byte after a word becomes the space
    size = ends - starts + 1
    joined_end = np.cumsum(size)
    joined_start = joined_end - size
    keep = np.zeros(len(buf) + 1, np.int8)
    keep[starts] += 1
    keep[ends + 1] -= 1
    buf[ends] = 32
    joined = memoryview(buf[np.cumsum(keep[:-1], dtype=np.int8) > 0].tobytes())
    joined_end -= 1
    digest = xxhash.xxh64_intdigest
    for_rows = [r for r in range(hi - lo) if n[r]]
    block: list[int] = []
    firsts, rows, counts = [], [], []

    def flush() -> None:
        if not rows:
            return
        sums = _signs(np.array(block, np.uint64), np.array(firsts))
        group = np.array(rows)
        total = np.array(counts)
        np.add.at(tally, group, sums)
        np.add.at(shingles, group, total)
        block.clear(), firsts.clear(), rows.clear(), counts.clear()

    tally = np.zeros((hi - lo, 64), np.int64)
    shingles = np.zeros(hi - lo, np.int64)
    for r in for_rows:
        a, k = int(first[r]), int(n[r])
        m = max(1, k - width + 1)
        for at in range(0, m, _WORDS):  # a very long text in pieces
            top = min(m, at + _WORDS)
            s = joined_start[a + at : a + top].tolist()
            e = joined_end[a + at + min(width, k) - 1 : a + top + min(width, k) - 1].tolist()
            firsts.append(len(block))
            rows.append(r)
            counts.append(top - at)
            block.extend([digest(joined[x:y], seed) for x, y in zip(s, e)])
            if len(block) >= _WORDS:
                flush()
    flush()
    major = (2 * tally > shingles[:, None]).astype(np.uint64)
    return out | (major << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, uid, fp (the 64 bits as a long); docs as `documents` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            parts = [fingerprints_of(text, lo, hi, width, seed) for lo, hi in textbuf.slices(text)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), pa.array(fp.view(np.int64))], ["doc_id", "uid", "fp"]
            )

    return docs.select("doc_id", "uid", "text").mapInArrow(run, "doc_id long, uid long, fp long")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """The kept bits of each of the 2^(radius+1) - 1 tables, as signed longs."""
    rng = np.random.default_rng(1000 + level)
    vectors = rng.integers(0, 1 << (radius + 1), 64)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        odd = np.bitwise_count((vectors & v).astype(np.uint64)) & 1
        mask = int((odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _bucket_links(radius: int):
    """Sorted (bucket, fp) rows -> for each fp its least linked-together fp of the bucket."""

    def local(fps: np.ndarray) -> np.ndarray:
        u = fps.view(np.uint64)
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
        label = np.arange(len(fps))
        while True:
            least = np.where(near, label[None, :], len(fps)).min(axis=1)
            least = least[least]
            if (least == label).all():
                return fps[label]
            label = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(k)))
            two = first[n == 2]
            u = f.view(np.uint64)
            two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= radius]
            a, b = [f[two]], [f[two + 1]]
            for i, m in zip(first[n > 2].tolist(), n[n > 2].tolist()):
                own = f[i : i + m]
                root = local(own)
                a.append(own[own != root])
                b.append(root[own != root])
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column("bucket").to_numpy()])
            f = np.concatenate([held_f, batch.column("fp").to_numpy()])
            if len(k) == 0:
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last bucket may go on
            yield links(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        if len(held_k):
            yield links(held_k, held_f)

    return run


def links(fps: DataFrame, radius: int = 4, most: int = 1024) -> DataFrame:
    """(a, b): links between distinct fps that join up all pairs within the radius.

    A bucket of more than ``most`` fingerprints is split by covering tables of the next
    level, whose masks are drawn anew: its fingerprints agree on the bits kept so far, so
    each level halves the free bits and, fingerprints being distinct, a bucket of f free
    bits holds at most 2^f.  No bucket is cut short.
    """
    rows = fps.select("fp", F.lit(0).cast("long").alias("bucket"))
    level, found = 0, None
    while True:
        tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(covering_masks(radius, level))])
        rows = rows.select("fp", "bucket", F.explode(tables).alias("x")).select(
            F.xxhash64("bucket", "x.t", F.col("fp").bitwiseAND(F.col("x.m"))).alias("bucket"), "fp"
        )
        large = materialise(rows.groupBy("bucket").count().filter(F.col("count") > most).select("bucket"), "large")
        more = level < 8 and bool(large.take(1))
        small = rows.join(large, "bucket", "left_anti") if more else rows
        ready = small.repartition("bucket").sortWithinPartitions("bucket", "fp").select("bucket", "fp")
        part = ready.mapInArrow(_bucket_links(radius), "a long, b long")
        found = part if found is None else found.union(part)
        if not more:
            return found
        rows = materialise(rows.join(large, "bucket", "left_semi"), "split")
        level += 1


def candidates(docs: DataFrame, reps: DataFrame, width: int, radius: int) -> DataFrame:
    """(a, b): sids of ``reps`` (sid, uid) whose fingerprints join up within the radius.

    A set is paired with the least of its own fingerprint, and these as `links` pairs their
    fingerprints; docs as `documents` gives them.
    """
    marked = materialise(fingerprints(docs, width).select("uid", "fp").join(reps.select("uid", "sid"), "uid").select("sid", "fp").distinct(), "fingerprints")
    firsts = materialise(marked.groupBy("fp").agg(F.min("sid").alias("first")), "firsts")
    same = marked.join(firsts, "fp").filter("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    near = links(firsts.select("fp"), radius).distinct()
    of = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_sid"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    return same.union(near.filter("a <> b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42
) -> DataFrame:
    """doc_id, uid, fp, component_id (the least doc_id reachable, itself included).

    Words are runs of non-white-space with A-Z lower-cased; shingles are ``width`` words;
    a shorter text is one shingle; a null or wordless text has fingerprint zero and links
    like any other.  Repeated rows give repeated rows.  A null doc_id is never the least
    unless no other is reachable.  Extra columns are ignored; the table may be empty.
    """
    marked = materialise(fingerprints(documents(docs, id_col, text_col), width, seed), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(links(distinct, radius), "a", "b")
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    tops = known.filter("linked").groupBy("root").agg(F.min("least").alias("top"))
    named = known.join(tops, "root", "left").filter("n > 1 OR linked").select("fp", F.coalesce("top", "least").alias("top"))
    return marked.join(named, "fp", "left").select(
        "doc_id", "uid", "fp", F.coalesce("top", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, find=near_duplicates, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their component: one each.

    The least doc_id stays; of rows with one id the least uid; of equal rows one.  Rows
    without an id go if a row with one is in their component, else they all stay.  Null and
    empty texts are texts like any other, so one of them stays; an empty table stays empty.
    """
    found = materialise(find(docs, **options).select("doc_id", "uid", "component_id"), "components")
    first = F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("keep_uid")
    tops = materialise(found.groupBy("component_id").agg(first, F.count("*").alias("n")).filter("n > 1"), "tops")
    again = found.join(tops, "component_id").select("uid", "keep_uid")
    lost = checked_broadcast(materialise(again.filter("uid <> keep_uid").select("uid").distinct(), "lost"))
    twice = materialise(again.filter("uid = keep_uid").groupBy("uid").count().filter("count > 1").select("uid"), "twice")
    twice = checked_broadcast(twice)
    # the table's own columns travel in one struct, so that no name can clash
    held = docs.select(F.struct("*").alias("row"), row_uid(docs).alias("uid")).join(lost, "uid", "left_anti")
    kept = held.join(twice, "uid", "left_anti").union(held.join(twice, "uid", "left_semi").dropDuplicates(["uid"]).select("uid", "row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def fingerprint_hex(column: str = "fp"):
    return hex64(F.col(column))
