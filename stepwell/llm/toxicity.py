"""Toxicity by a classifier chain of linear models over hashed words.

Categories are predicted one after another; each model sees the words and the
probabilities of the categories before it.  In training those are out-of-fold
predictions, so a later model learns how far an earlier one can be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import textbuf
from stepwell.llm.common import documents

BITS = 18
#: Labelled rows a chain is fitted on, the least by hash of doc_id.
SAMPLE = 8000
FOLDS = 3
CHAIN = ("low_quality", "toxic")
#: Rejected from here on.
THRESHOLD = 0.5

#: Bytes of a stem, and how many distinct words of a row must share it to count again.
STEM = 6
STEM_COUNTS = (1, 2, 4)

_WORD = np.arange(256, dtype=np.uint8)
_WORD[65:91] += 32
_WORD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _stems(words: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Row and bucket of the stems of distinct words, once for each count they reach."""
    long = end - start > STEM
    row, start = row[long].astype(np.int64), start[long]
    code = np.zeros(len(start), np.uint64)
    for j in range(STEM):
        code = (code << np.uint64(8)) | words[start + j].astype(np.uint64)
    stem = (textbuf.mix(code) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique((row << BITS) | stem, return_counts=True)
    mask, out = (1 << BITS) - 1, []
    for level, least in enumerate(STEM_COUNTS):
        far = key[count >= least]
        out.append((far & ~mask) | ((far + (level + 1) * 77_777) & mask))
    return np.concatenate(out)


def features(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of rows lo..hi: row (from 0) and word bucket, sorted.

    Further buckets tell which stems occur in one, two or four distinct words, so that
    inflected and compounded forms add up.  Three more of 16 each tell the shares of
    capitals, of exclamation marks and of repeated words.
    """
    buf, row_start, row_end = textbuf.buffer(column, lo, hi)
    words = _WORD[buf]
    starts, ends, hashes = textbuf.word_hashes(words)
    row = np.searchsorted(row_start, starts, side="right") - 1
    key, at = np.unique((row.astype(np.int64) << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_index=True)
    stems = _stems(words, key >> BITS, starts[at], ends[at])
    n = hi - lo
    size = np.maximum(row_end - row_start, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[row_end] - total[row_start]) / size

    n_words = np.maximum(np.bincount(row, minlength=n), 1)
    repeats = 1 - np.bincount(key >> BITS, minlength=n) / n_words
    style = [share((buf >= 65) & (buf < 91)), 8 * share(buf == 33), repeats]
    top = [(1 << BITS) - 16 * (j + 1) + np.minimum(x * 16, 15).astype(np.int64) for j, x in enumerate(style)]
    rows = np.arange(n, dtype=np.int64) << BITS
    key = np.unique(np.concatenate([key, stems, *(rows | t for t in top)]))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Linear:
    """Weights per word bucket, per earlier category, and a bias."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, row: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = len(before)
        z = np.bincount(row, self.words[word], minlength=n)[:n] + before @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, word: np.ndarray, before: np.ndarray, y: np.ndarray, rounds: int = 100) -> Linear:
    """Logistic regression on word presence, scaled by each word's log-odds in the data.

    Words of fewer than four rows, and words whose shares in the two classes differ by less
    than eight standard errors, are left out.  Full-batch gradient steps with per-weight step sizes.
    """
    n, size = len(y), 1 << BITS
    count = np.bincount(word, minlength=size)
    positive = np.bincount(word, y[row], minlength=size)
    p, q = max(y.sum(), 1), max(n - y.sum(), 1)
    odds = np.log((positive + 0.5) / (p + 1)) - np.log((count - positive + 0.5) / (q + 1))
    share = count / n
    error = np.sqrt(share * (1 - share) * (1 / p + 1 / q)) + 1e-9
    sure = np.abs(positive / p - (count - positive) / q) > 8 * error
    scale = np.where((count >= 4) & sure, odds, 0.0)
    used = scale[word] != 0
    row, word = row[used], word[used]
    value = scale[word]
    w, e, b = np.zeros(size), np.zeros(before.shape[1]), float(np.log(p / q))
    gw, ge, gb = np.full(size, 1e-6), np.full(len(e), 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(row, w[word] * value, minlength=n)[:n] + before @ e + b
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        dw = np.bincount(word, r[row] * value, minlength=size) + 0.1 * w
        de, db = before.T @ r + 0.1 * e, r.sum()
        gw += dw * dw
        ge += de * de
        gb += db * db
        w -= 0.3 * dw / np.sqrt(gw)
        e -= 0.3 * de / np.sqrt(ge)
        b -= 0.3 * db / np.sqrt(gb)
    return Linear(w * scale, e, b)


def fit_chain(row: np.ndarray, word: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model per column of labels, later ones fitted on out-of-fold probabilities."""
    n, chain = len(labels), []
    before = np.zeros((n, 0))
    fold = np.arange(n) % folds
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        held = np.zeros(n)
        for k in range(folds):
            inside = fold != k
            where = np.cumsum(inside) - 1
            take = inside[row]
            model = fit(where[row[take]], word[take], before[inside], y[inside])
            rest = ~inside
            where = np.cumsum(rest) - 1
            take = rest[row]
            held[rest] = model.predict(where[row[take]], word[take], before[rest])
        chain.append(fit(row, word, before, y))
        before = np.column_stack([before, held])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """At most ``sample`` labelled rows as (row, word, labels) arrays on the driver."""
    chosen = (
        labels.select(
            F.col("doc_id").cast("long").alias("label_id"),
            (1 - F.col("quality")).cast("int").alias("low_quality"),
            F.col("toxic").cast("int").alias("toxic"),
        )
        .dropna()
        .distinct()
        .orderBy(F.xxhash64("label_id"), "label_id", "low_quality", "toxic")
        .limit(sample)
    )
    base = documents(docs)
    rows = base.join(F.broadcast(chosen), base["doc_id"] == chosen["label_id"]).select("uid", "text", *CHAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, words = batch.column("text"), []
            for lo, hi in textbuf.slices(text):
                row, word = features(text, lo, hi)
                words += np.split(word.astype(np.int32), np.searchsorted(row, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array(words, pa.list_(pa.int32())), *(batch.column(c) for c in CHAIN)],
                ["uid", "words", *CHAIN],
            )

    got = rows.mapInArrow(run, "uid long, words array<int>, low_quality int, toxic int").toArrow()  # no Python object for a word
    got = got.sort_by([(c, "ascending") for c in ("uid", *CHAIN)]).combine_chunks()
    n = pc.list_value_length(got["words"]).to_numpy()
    word = pc.list_flatten(got["words"]).to_numpy()
    return np.repeat(np.arange(len(got), dtype=np.int32), n), word, np.column_stack([got[c].to_numpy() for c in CHAIN])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear]:
    """The chain of `fit_chain`, fitted on `labelled_sample`; none without labels."""
    row, word, y = labelled_sample(docs, labels, sample)
    chain = fit_chain(row, word, y) if len(y) else []
    del row, word, y
    textbuf.release()  # the driver keeps none of the sample
    return chain


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, uid, p_low_quality, p_toxic, rejected (p_toxic >= threshold), for every row.

    ``labels`` (doc_id, quality, toxic) name good quality and toxic documents by 1; rows
    with a null are left out.  The chain is fitted on at most ``sample`` labelled rows; with
    none, all probabilities are 0.  Whole texts are scored; null is the empty text; repeated
    rows, null ids and extra columns are fine; tables may be empty.
    """
    chain = fitted(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            out = [np.zeros((0, len(CHAIN)))]
            for lo, hi in textbuf.slices(text):
                row, word = features(text, lo, hi)
                before = np.zeros((hi - lo, 0))
                for model in chain:
                    before = np.column_stack([before, model.predict(row, word, before)])
                out.append(before if chain else np.zeros((hi - lo, len(CHAIN))))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= threshold)],
                ["doc_id", "uid", "p_low_quality", "p_toxic", "rejected"],
            )

    schema = "doc_id long, uid long, p_low_quality double, p_toxic double, rejected boolean"
    return documents(docs).select("doc_id", "uid", "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and the columns beside them) that are not rejected.

    Null texts are empty ones; repeated rows are judged alike; null ids are never labelled;
    without labels, or with an empty table, all rows stay.
    """
    chain = fitted(docs, labels, options.get("sample", SAMPLE))
    threshold = options.get("threshold", THRESHOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            keep = [np.zeros(0, bool)]
            for lo, hi in textbuf.slices(text):
                row, word = features(text, lo, hi)
                before = np.zeros((hi - lo, 0))
                for model in chain:
                    before = np.column_stack([before, model.predict(row, word, before)])
                keep.append(before[:, -1] < threshold if chain else np.ones(hi - lo, bool))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
