"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import pieces, textbuf
from stepwell.llm.common import documents


def _whole(vocab: pieces.Vocabulary, column: pa.Array, lo: int, hi: int) -> np.ndarray:
    return np.array(vocab.lengths([t or "" for t in column.slice(lo, hi - lo).to_pylist()]), np.int64)


def count_batch(vocab: pieces.Vocabulary, column: pa.Array, split: bool, fold: bool) -> np.ndarray:
    """Tokens of each row; slices hold about the same number of bytes."""
    out = []
    for lo, hi in textbuf.slices(column):
        if not split:
            out.append(_whole(vocab, column, lo, hi))
            continue
        buf, row_start, _ = textbuf.buffer(column, lo, hi)
        words, first = pieces.dropped(buf, row_start, fold)
        known = vocab.look_up(words, vocab.piece_lengths)
        each = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(each)])
        out.append(total[np.append(first[1:], len(words))] - total[first])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    split: bool = True,
    fold: bool = True,
) -> DataFrame:
    """doc_id, uid, n_bytes, n_tokens for every row, in whole texts.

    ``split``: texts are cut at white space and at points beside letters, which holds for
    a tokenizer that drops white space and splits letters from other characters before
    merging (as word-end BPE does); each distinct piece of a batch is encoded once.
    False encodes whole texts.  ``fold``: the tokenizer lower-cases, so pieces that differ
    in A-Z only are one.  ``tokenizer`` is a path every executor can read.  Null is the
    empty text with 0 tokens; rows stay as they are, repeated ones and null ids included;
    extra columns are ignored; the table may be empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces.vocabulary(tokenizer, "lengths")
        for batch in batches:
            n = count_batch(vocab, batch.column("text"), split, fold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), batch.column("n_bytes"), pa.array(n)],
                ["doc_id", "uid", "n_bytes", "n_tokens"],
            )

    base = documents(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return base.mapInArrow(run, "doc_id long, uid long, n_bytes long, n_tokens long")
