"""Which passages lie in which texts, both tables large: an index of byte q-grams.

A passage of eight bytes or more occurs only where each of its 8-grams does; shorter ones
are looked up by grams of four, two or one byte.  The texts are scanned twice.  The first
scan counts in how many texts the passages' grams occur, added up in tasks before they are
shuffled; a passage with a gram that no text holds is done with.  The second scan looks for
the rarest gram of each passage left, and what meets there is compared as whole strings.
Scans know the grams by a bitmap of bounded size: what it lets through in vain goes in the
join with the grams themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.operators.shared import forget, stored

SIZES = (8, 4, 2, 1)
#: Grams of a passage that are counted, evenly spaced: any one of them finds all its places.
SPACED = 64
#: Bits of a bitmap for each gram, and at most.
BITS, MOST_BITS = 16, 1 << 28
#: Bytes of text taken at a time.
BLOCK = 1 << 20
#: Texts that empty passages are dealt to.
PARTS = 32


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's start in them; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _packed(data: np.ndarray, size: int) -> np.ndarray:
    """Every run of ``size`` bytes as one number."""
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _place(gram: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A gram's bit."""
    h = (gram ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) & np.uint64(bits - 1)


def _grams(column: pa.Array, sizes: list[int], seen: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, row, gram), each once a block of text; only those that the bitmap knows."""
    data, offsets = _bytes(column)
    bits = 8 * len(seen) if seen is not None else 0
    for lo in range(int(offsets[0]), int(offsets[-1]), BLOCK):
        for size in sizes:
            gram = _packed(data[lo : min(lo + BLOCK + size - 1, int(offsets[-1]))], size)
            at = np.arange(len(gram))
            if seen is not None:
                bit = _place(gram, size, bits)
                at = np.flatnonzero(seen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            row = np.searchsorted(offsets, at + lo, "right") - 1
            inside = at + lo + size <= offsets[row + 1]
            row, found = row[inside], gram[at[inside]].view(np.int64)
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            yield size, row[new], found[new]


def _passage_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(passage) -> (passage, size, gram), at most SPACED grams each."""
    for batch in batches:
        column = batch.column("passage")
        data, offsets = _bytes(column)
        rows, sizes, grams = [], [], []
        for i in range(len(column)):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            size = next(s for s in SIZES if s <= hi - lo)
            at = np.unique(np.linspace(0, hi - lo - size, SPACED).astype(np.int64))
            found = np.unique(np.concatenate([_packed(data[lo + a : lo + a + size], size) for a in at.tolist()]))
            rows.append(np.full(len(found), i))
            sizes.append(np.full(len(found), size, np.int32))
            grams.append(found.view(np.int64))
        if rows:
            columns = [column.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(grams))]
            yield pa.RecordBatch.from_arrays(columns, ["passage", "size", "gram"])


def _bitmap(grams: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bitmap of (size, gram) rows and the sizes that occur; at most MOST_BITS bits reach the driver."""
    counts = grams.groupBy("size").count().collect()
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS * sum(r["count"] for r in counts)):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gram = batch.column("size").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
            bit = np.concatenate([np.zeros(0, np.uint64), *(_place(gram[size == s], s, bits) for s in np.unique(size).tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(bit.view(np.int64))], ["bit"])

    found = grams.mapInArrow(words, "bit long")
    held = found.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    return out.view(np.uint8), [r["size"] for r in counts]


def _scan(texts: DataFrame, grams: DataFrame, count: bool) -> DataFrame:
    """(size, gram, n) added up by tasks, or (size, gram, uid), of the grams that the texts hold."""
    bitmap, sizes = _bitmap(grams)
    seen = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for size, row, gram in _grams(batch.column("text"), sizes, seen.value):
                if count:
                    gram, last = np.unique(gram, return_counts=True)
                else:
                    last = uid[row]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), size, np.int32)), pa.array(gram), pa.array(last)], ["size", "gram", "last"])

    return texts.select("uid", "text").mapInArrow(run, "size int, gram long, last long")


def containing(texts: DataFrame, id_col: str, text: Column, items: DataFrame, item_col: str, passage: Column) -> DataFrame:
    """(id_col, item_col), distinct: the texts that contain a passage, compared as they are.

    Null texts and passages are in no pair; an empty passage is in every text that is not
    null.  Tables may be of any size and may be empty; repeated rows give one pair.
    """
    base = texts.select(texts[id_col].alias("_id"), text.alias("text")).filter("text IS NOT NULL")
    base = base.withColumn("uid", F.xxhash64("_id", "text"))
    given = items.select(items[item_col].alias("_item"), passage.alias("passage")).filter("passage IS NOT NULL")
    given = stored(given, "passages")
    distinct = given.filter("passage <> ''").select("passage").distinct()
    grams = stored(distinct.mapInArrow(_passage_grams, "passage string, size int, gram long"), "grams")
    if not grams.take(1):
        found = grams.select("passage", F.lit(0).cast("long").alias("uid"))
    else:
        counts = _scan(base, grams.select("size", "gram").distinct(), True).groupBy("size", "gram").agg(F.sum("last").alias("n"))
        known = grams.join(counts, ["size", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rarest = known.groupBy("passage").agg(F.min_by(F.struct("size", "gram"), F.struct("n", "gram")).alias("g"), F.min("n").alias("n"))
        probes = stored(rarest.filter("n > 0").select("passage", "g.size", "g.gram"), "probes")
        met = _scan(base, probes.select("size", "gram").distinct(), False).withColumnRenamed("last", "uid")
        found = met.join(probes, ["size", "gram"]).select("passage", "uid").distinct()
    found = stored(found, "candidates")
    forget(grams)
    hits = base.join(found, "uid").filter(F.contains("text", F.col("passage"))).select("_id", "passage")
    pairs = hits.join(given, "passage").select("_id", "_item")
    anywhere = given.filter("passage = ''").select("_item", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    every = base.select("_id", F.pmod("uid", F.lit(PARTS)).cast("int").alias("part")).join(anywhere, "part").select("_id", "_item")
    return pairs.union(every).distinct().select(F.col("_id").alias(id_col), F.col("_item").alias(item_col))
