"""Shingle sets of texts, built in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepwell.llm import textbuf

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: One set of so many is looked at for common shingles, seen in so many of these, at most so many.
SAMPLE, COMMON, MAX_COMMON = 16, 3, 500_000


def shingle_sets(column: pa.Array, lo: int, hi: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by (row, hash): rows, hashes; and the size and hash of each row's set."""
    buf, row_start, _ = textbuf.buffer(column, lo, hi)
    starts, _, words = textbuf.word_hashes(_FOLD[buf])
    first = np.searchsorted(starts, row_start)
    n = np.diff(np.append(first, len(starts)))
    row = np.repeat(np.arange(hi - lo), n)
    rows, hashes = [], []
    for k in range(1, width + 1):  # a shorter text is one shingle
        g = textbuf.grams(words, k)
        if k < width:
            at = first[n == k]
        else:
            at = np.flatnonzero(row[: len(g)] == row[k - 1 : k - 1 + len(g)])
        rows.append(row[at])
        hashes.append(g[at])
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h = r[new], h[new]
    size = np.bincount(r, minlength=hi - lo)
    total = np.zeros(hi - lo, np.uint64)
    np.add.at(total, r, textbuf.mix(h))
    return r, h, size, textbuf.mix(total + size.astype(np.uint64))


def mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """``make(batch, lo, hi)`` gives the columns of ``schema`` for rows lo..hi."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textbuf.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(make(batch, lo, hi), names)

    return docs.select("doc_id", "uid", "text").mapInArrow(run, schema)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sampled(width: int):
    def make(batch: pa.RecordBatch, lo: int, hi: int):
        r, h, _, sid = shingle_sets(batch.column("text"), lo, hi, width)
        return [as_long(h[(sid % np.uint64(SAMPLE) == 0)[r]])]

    return make


def whole(width: int):
    def make(batch: pa.RecordBatch, lo: int, hi: int):
        _, h, size, sid = shingle_sets(batch.column("text"), lo, hi, width)
        offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        return [as_long(sid), pa.ListArray.from_arrays(offsets, as_long(h))]

    return make
