"""Token-id files: Re-Pair grammars per shard with random-access decoding.

A shard holds about ``SHARD`` ids of consecutive documents.  Its frequent id pairs are
replaced by nonterminals, round after round, until none is left that saves room or the
16-bit symbols run out; a round names its frequent pairs and replaces each where it
outranks its neighbours.  No pair crosses a document's end.
The file keeps the ids used, the rules (left, right), the expansion length of every
rule, the remaining symbols, and per document its symbols and tokens, so a document or
a range of its tokens is decoded from its own symbols alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm import pieces, textbuf
from stepwell.llm.common import documents, shared_dir

SHARD = 1 << 20
#: A rule takes the room of four symbols in the file, so rarer pairs cost more than they save.
LEAST = 5
FILE_SCHEMA = (
    "shard long, n_tokens long, terminals binary, rules binary, lengths binary, symbols binary, "
    "doc_ids array<long>, uids array<long>, doc_symbols array<int>, doc_tokens array<int>"
)


@dataclass
class Grammar:
    terminals: np.ndarray  # uint32: symbol -> id, for the first symbols
    rules: np.ndarray  # uint16 [n, 2]: later symbols -> two earlier ones
    symbols: np.ndarray  # uint16
    ends: np.ndarray  # symbols before the end of each document

    def lengths(self) -> np.ndarray:
        """Expansion length of every symbol."""
        base = len(self.terminals)
        out = np.ones(base + len(self.rules), np.uint32)
        for i, (a, b) in enumerate(self.rules.tolist()):
            out[base + i] = out[a] + out[b]
        return out


def _runs(rank: np.ndarray) -> np.ndarray:
    """Every second place of runs of one pair that outrank both neighbours."""
    at = np.flatnonzero((rank[:-1] >= 0) & (rank[:-1] == rank[1:]))
    if len(at) == 0:
        return at
    head = np.concatenate([[True], at[1:] != at[:-1] + 1])
    head[1:] |= rank[at[1:]] != rank[at[:-1]]
    begin = np.flatnonzero(head)
    length = np.diff(np.append(begin, len(at))) + 1
    begin = at[begin]
    top = (rank[begin - 1] < rank[begin]) & (rank[begin + length] < rank[begin])
    begin, length = begin[top], (length[top] + 1) // 2
    return np.repeat(begin, length) + 2 * (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))


def compress(ids: np.ndarray, doc_ends: np.ndarray, least: int = LEAST) -> Grammar:
    """Re-Pair over uint16 symbols; ids are uint32, doc_ends count ids.

    Pairs inside documents that occur ``least`` times or more are replaced, the more
    frequent of overlapping ones first, until a round replaces none or all symbols are
    named.  A pair that is not frequent never becomes so again unless a new symbol makes
    it, so after the first round only places beside new symbols, and those that lost to a
    neighbour, are looked at.
    """
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    seen[ids] = True
    terminals = np.flatnonzero(seen).astype(np.uint32)
    name = np.zeros(len(seen), np.uint32)
    name[terminals] = np.arange(len(terminals))
    seq = name[ids]
    last = np.zeros(len(ids), bool)
    last[doc_ends[doc_ends > 0] - 1] = True
    live = np.ones(len(ids), bool)
    rules: list[np.ndarray] = []
    size = len(terminals)
    while size < 1 << 16:
        at = np.flatnonzero(live[:-1] & ~last[:-1])
        if len(at) == 0:
            break
        both = (seq[:-1] << np.uint32(16)) | seq[1:]
        key = (both[at].astype(np.uint64) << np.uint64(32)) | at.view(np.uint64)
        key.sort()
        halves = key.astype("<u8", copy=False).view("<u4").reshape(-1, 2)
        place, pair = halves[:, 0], halves[:, 1]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        n = np.diff(np.append(first, len(pair)))
        often = np.flatnonzero(n >= least)
        often = often[np.argsort(n[often], kind="stable")][-((1 << 16) - size) :]
        if len(often) == 0:
            break
        group = np.full(len(n), -1, np.int32)
        group[often] = np.arange(len(often))
        group = np.repeat(group, n)
        named = group >= 0
        rank = np.full(len(seq) + 2, -1, np.int32)  # one more at both ends
        rank[place[named] + np.uint32(1)] = group[named]
        own = rank[1:-1]
        pick = np.concatenate([np.flatnonzero((own > rank[:-2]) & (own > rank[2:])) + 1, _runs(rank)])
        used = np.bincount(rank[pick], minlength=len(often))
        pick = pick[used[rank[pick]] >= least]
        if len(pick) == 0:
            break
        kept = np.flatnonzero(used >= least)[::-1]
        fresh = np.zeros(len(often), np.uint32)
        fresh[kept] = size + np.arange(len(kept))
        replaced = pair[first[often[kept]]]
        rules.append(np.column_stack([replaced >> np.uint32(16), replaced & np.uint32(0xFFFF)]))
        live = rank[1:-1] >= 0
        pick -= 1
        seq[pick] = fresh[rank[pick + 1]]
        last[pick] = last[pick + 1]
        live[pick] = True
        live[pick[pick > 0] - 1] = True
        stay = np.ones(len(seq), bool)
        stay[pick + 1] = False
        # the place before a new symbol may itself be the second half of one
        live[pick[pick > 1] - 2] |= ~stay[pick[pick > 1] - 1]
        seq, last, live = seq[stay], last[stay], live[stay]
        size += len(kept)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    # documents without ids end where the one before does
    ends = np.concatenate([[0], np.flatnonzero(last) + 1])[np.cumsum(np.diff(doc_ends, prepend=0) > 0)]
    return Grammar(terminals, flat.astype(np.uint16), seq.astype(np.uint16), ends)


def _expansions(terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' expansions end to end, and where each starts."""
    start = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat = np.empty(int(start[-1]), np.uint32)
    flat[: len(terminals)] = terminals
    begin, size, base = start.tolist(), lengths.tolist(), len(terminals)
    for i, (a, b) in enumerate(rules.tolist()):
        at, n, m = begin[base + i], size[a], size[b]
        flat[at : at + n] = flat[begin[a] : begin[a] + n]
        flat[at + n : at + n + m] = flat[begin[b] : begin[b] + m]
    return flat, start


def _expand(symbols: np.ndarray, flat: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = lengths[symbols].astype(np.int64)
    end = np.cumsum(n)
    if len(end) == 0:
        return np.zeros(0, np.uint32)
    return flat[np.repeat(start[symbols] - end + n, n) + np.arange(end[-1])]


class Shard:
    """One row of a token file."""

    def __init__(self, row: dict) -> None:
        self.terminals = np.frombuffer(row["terminals"], np.uint32)
        self.rules = np.frombuffer(row["rules"], np.uint16).reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], np.uint32)
        self.symbols = np.frombuffer(row["symbols"], np.uint16)
        self.doc_symbols = np.asarray(row["doc_symbols"], np.int64)
        self.flat, self.start = _expansions(self.terminals, self.rules, self.lengths)

    def ids(self) -> np.ndarray:
        return _expand(self.symbols, self.flat, self.start, self.lengths)

    def tokens(self, doc: int, lo: int, hi: int) -> np.ndarray:
        """Tokens lo..hi of the doc-th document, from the symbols that cover them."""
        own = self.symbols[self.doc_symbols[doc - 1] if doc else 0 : self.doc_symbols[doc]]
        end = np.cumsum(self.lengths[own], dtype=np.int64)
        a = int(np.searchsorted(end, lo, side="right"))
        b = int(np.searchsorted(end, hi, side="left")) + 1
        skip = lo - (int(end[a - 1]) if a else 0)
        return _expand(own[a:b], self.flat, self.start, self.lengths)[skip : skip + hi - lo]


def _encode(vocab: pieces.Vocabulary, text: pa.Array, lo: int, hi: int, end: int, split: bool) -> tuple[bytes, np.ndarray]:
    """uint16 ids of rows lo..hi, each row's ended by ``end``, and its number of ids."""
    buf, row_start, row_end = textbuf.buffer(text, lo, hi)
    cut = pieces.leading(buf, row_start, row_end) if split else None
    tail = np.uint16(end).tobytes()
    pack = lambda x: np.array(x, np.uint16).tobytes()
    if cut is None:
        rows = [pack(x) + tail for x in vocab.encode([t or "" for t in text.slice(lo, hi - lo).to_pylist()])]
        return b"".join(rows), np.array([len(x) // 2 for x in rows])
    parts, first = cut
    coded = parts.dictionary_encode()
    distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    known = vocab.look_up(distinct, vocab.piece_ids, once=True)
    got = list(map(known.__getitem__, distinct))
    size = np.fromiter(map(len, got), np.int64, len(got)) // 2
    begin = np.cumsum(size) - size
    each = size[code]
    n = np.concatenate([[0], np.cumsum(each)])
    edge = np.append(first, len(code))
    at = np.repeat(begin[code] - n[:-1], each) + np.arange(n[-1])
    # each row's end id goes behind its last piece
    ids = np.insert(np.frombuffer(b"".join(got), np.uint16)[at], n[edge[1:]], end)
    return ids.tobytes(), n[edge[1:]] - n[edge[:-1]] + 1


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", split: bool = True
) -> None:
    """Encode whole texts and write shards in ascending doc_id order (nulls last, then uid).

    ``split``: the tokenizer is byte-level, so texts may be cut before single white space
    and beside points (see `pieces`).  ids must be below 65,536.  Null is the empty text,
    which holds the end id alone; repeated rows stay; an empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces.vocabulary(tokenizer, "ids")
        task = TaskContext.get().partitionId() << 32
        held: list[bytes] = []
        ids: list[list] = [[], []]
        sizes: list[np.ndarray] = []
        number = 0

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), np.uint16).astype(np.uint32)
            n = np.concatenate(sizes)
            g = compress(tokens, np.cumsum(n))
            row = {
                "shard": task + number, "n_tokens": len(tokens), "terminals": g.terminals.tobytes(),
                "rules": g.rules.tobytes(), "lengths": g.lengths().tobytes(), "symbols": g.symbols.tobytes(),
                "doc_ids": ids[0][:], "uids": ids[1][:], "doc_symbols": g.ends.tolist(), "doc_tokens": n.tolist(),
            }
            held.clear(), sizes.clear(), ids[0].clear(), ids[1].clear()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema(
            [("shard", pa.int64()), ("n_tokens", pa.int64())]
            + [(c, pa.binary()) for c in ("terminals", "rules", "lengths", "symbols")]
            + [("doc_ids", pa.list_(pa.int64())), ("uids", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int32()))]
        )
        for batch in batches:
            text = batch.column("text")
            for lo, hi in textbuf.slices(text, 2 * SHARD):
                data, n = _encode(vocab, text, lo, hi, end, split)
                held.append(data)
                sizes.append(n)
                ids[0] += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                ids[1] += batch.column("uid").slice(lo, hi - lo).to_pylist()
                if sum(map(len, held)) >= 2 * SHARD:
                    yield flush()
                    number += 1
        if held:
            yield flush()

    base = documents(docs, id_col, text_col).select("doc_id", "uid", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("uid").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of a token file: doc_id, uid, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it: sums of shards within groups of
    shards and of groups before are added, so one task holds one row per 1,024 shards.
    """
    shards = spark.read.schema(FILE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Shard(row).ids()
                n = np.asarray(row["doc_tokens"], np.int64)
                end = np.cumsum(n)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(end.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), row["shard"])), pa.array(row["doc_ids"], pa.int64()), pa.array(row["uids"], pa.int64()),
                        pa.array(end - n), pa.array(n), pa.array(crc, pa.int64()),
                    ],
                    ["shard", "doc_id", "uid", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.mapInArrow(
        run, "shard long, doc_id long, uid long, inside long, n_tokens long, ids_crc32 long"
    )
    # the partition number is the high half of a shard's number
    sizes = shards.select("shard", "n_tokens", F.expr("shard DIV 4294967296 * 64 + shard % 4294967296 DIV 1024").alias("bunch"))
    bunches = sizes.groupBy("bunch").agg(F.sum("n_tokens").alias("total"))
    before = bunches.withColumn("before", F.sum("total").over(Window.orderBy("bunch")) - F.col("total")).select("bunch", "before")
    in_bunch = Window.partitionBy("bunch").orderBy("shard")
    starts = sizes.withColumn("inner", F.sum("n_tokens").over(in_bunch) - F.col("n_tokens")).join(before, "bunch")
    starts = starts.select("shard", (F.col("before") + F.col("inner")).alias("shard_start"))
    return rows.join(starts, "shard").select(
        "doc_id", "uid", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write a token file in the shared folder and read it back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(spark, path)
