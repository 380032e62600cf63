"""SentencePiece encoding and decoding by a max-plus parallel scan.

A sequence of pieces is the merge model's encoding of a text exactly if every pair of
neighbours, encoded alone, stays that pair: the first merge across a border would happen
in the pair alone too.  So an encoding is the one path of weight zero through the
pieces of a text, where a pair weighs zero if it stays and minus infinity if not.

A giant text is cut into chunks.  The state at a cut is the piece that holds the
character before it.  A chunk's transfer matrix over the states at its two cuts holds
the greatest weight of a path between them; matrices multiply in the max-plus
semiring, which is associative, so products over blocks of chunks give the states
at all cuts, and every chunk is then traced back alone between its two states.

No piece has a space mark behind another character, so words do not touch; whole
words inside a chunk are encoded by the library, each distinct one once per batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import textbuf
from stepwell.llm.common import documents

MARK = "▁"
CHUNK = 4096
GIANT = 16384
#: Characters of the neighbours that a chunk carries; no piece is longer.
REACH = 64
NO = -np.inf
#: A character of no piece: what stands behind it is encoded as if alone.
_APART = "\uE000"


class Model:
    """A SentencePiece merge model with a bounded memory of words and pairs."""

    def __init__(self, path: str, keep: int = 200_000) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = sp.id_to_piece(list(range(n)))
        odd = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = {p for p, x in zip(names, odd) if not x}
        self.most = max(map(len, self.pieces))
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.raw_lengths = np.array([len(x) for x in raw])
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.skip = len(sp.encode(_APART))
        if self.most > REACH:
            raise ValueError(f"a piece of {self.most} characters is longer than what chunks carry of their neighbours ({REACH})")
        probe = "\ufb01 \uff21  \u00b2 e\u0301"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model normalises texts; only models that leave them as they are can be cut into chunks")
        self.keep, self.known, self.pairs = keep, {}, {}

    def alone(self, text: str) -> list[int]:
        """Ids of marked text that stands within a word."""
        return self.sp.encode(_APART + text.replace(MARK, " "))[self.skip :]

    def stays(self, left: str, right: str) -> bool:
        """Whether two neighbouring units stay apart."""
        if right[0] == MARK and left[-1] != MARK:
            return True
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > self.keep:
                self.pairs.clear()
            got = self.pairs[left, right] = self.alone(left + right) == self.alone(left) + self.alone(right)
        return got

    def unit(self, text: str) -> bool:
        """A piece that the model makes of its own text, or one character."""
        return len(text) == 1 or (text in self.pieces and len(self.alone(text)) == 1)

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of whole words; a word's first mark is the one the library adds."""
        distinct = set(words)
        if len(self.known) + len(distinct) > self.keep:
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        new = [w for w in distinct if w not in self.known]
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            got = self.sp.encode([w[1:].replace(MARK, " ") for w in part], num_threads=1)
            self.known.update((w, np.array(x, np.uint16).tobytes()) for w, x in zip(part, got))
            if MARK in part:  # a last space alone
                self.known[MARK] = np.array(self.alone(MARK), np.uint16).tobytes()
        return self.known

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, space marks as spaces (the first one stands for no space)."""
        n = self.raw_lengths[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.raw[np.repeat(self.raw_starts[ids] - end + n, n) + np.arange(total)]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def split_words(text: str) -> list[str]:
    """Cut before every space mark that follows another character."""
    parts = text.split(MARK)
    out, lead = ([parts[0]] if parts[0] else []), 0
    for p in parts[1:]:
        lead += 1
        if p:
            out.append(MARK * lead + p)
            lead = 0
    if lead:
        out.append(MARK * lead)
    return out


def cut(text: str) -> list[tuple[str, str, str]]:
    """Chunks, each with the characters before and behind it."""
    return [
        (text[max(0, i - REACH) : i], text[i : i + CHUNK], text[i + CHUNK : i + CHUNK + REACH])
        for i in range(0, len(text), CHUNK)
    ]


def states_at(m: Model, before: str, after: str) -> list[tuple[int, int]]:
    """Units (start, end; 0 is the cut) that hold the character before a cut."""
    if not before:
        return [(0, 0)]
    text, c = before + after, len(before)
    found = []
    for a in range(max(0, c - m.most), c):
        for b in range(c, min(len(text), a + m.most) + 1):
            if m.unit(text[a:b]):
                found.append((a - c, b - c))
    return found


def _first_word(text: str, lo: int) -> int:
    """First position from lo on (at least 1) where a word starts; -1 if there is none."""
    i = max(lo, 1)
    while (i := text.find(MARK, i)) >= 0 and text[i - 1] == MARK:
        i += 1
    return i


def _last_word(text: str, hi: int) -> int:
    """Last position up to hi (at least 1) where a word starts; -1 if there is none."""
    i = hi
    while (i := text.rfind(MARK, 1, i + 1)) > 0 and text[i - 1] == MARK:
        i -= 1
    return i


def _paths(m: Model, text: str, begin: list[tuple[int, int]], stop: int) -> dict[tuple[int, int], tuple[int, int] | None]:
    """Units reached over staying pairs from the units ``begin``, each with the one before it.

    Units start before ``stop``; a unit that starts a word needs no unit before it.
    """
    back: dict[tuple[int, int], tuple[int, int] | None] = {u: None for u in begin}
    ending: dict[int, list[tuple[int, int]]] = {}
    for u in begin:
        ending.setdefault(u[1], []).append(u)
    for p in range(min(ending, default=stop), stop):
        for q in range(p + 1, min(len(text), p + m.most) + 1 if ending.get(p) else 0):
            if not m.unit(text[p:q]):
                continue
            for u in ending[p]:
                if u[0] == u[1] or m.stays(text[u[0] : u[1]], text[p:q]):
                    back[p, q] = u
                    ending.setdefault(q, []).append((p, q))
                    break
    return back


def _chain(back: dict, end: tuple[int, int]) -> list[tuple[int, int]]:
    """Units from the one behind the first to ``end``."""
    out = []
    while back[end] is not None:
        out.append(end)
        end = back[end]
    return out[::-1]


class Chunk:
    """A chunk between two cuts: its states, its matrix and its trace."""

    def __init__(self, m: Model, before: str, chunk: str, after: str) -> None:
        self.m, self.text, self.lo = m, before + chunk + after, len(before)
        self.hi = self.lo + len(chunk)
        self.enter = [(a + self.lo, b + self.lo) for a, b in states_at(m, before, chunk + after)]
        self.leave = [(a + self.hi, b + self.hi) for a, b in states_at(m, self.text[max(0, self.hi - REACH) : self.hi], after)]
        most = max(b for _, b in self.enter)
        # between the first and the last word start that no entering unit reaches
        self.first, self.last = _first_word(self.text[: self.hi], max(most, self.lo)), _last_word(self.text[: self.hi], self.hi - 1)
        self.seam = 0 <= self.first <= self.last and self.first >= most

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.enter), len(self.leave)), NO)
        if self.seam:
            tail = _paths(self.m, self.text, [(self.last, self.last)], self.hi)
            can = np.array([0.0 if v in tail else NO for v in self.leave])
            for i, u in enumerate(self.enter):
                if any(b == self.first for _, b in _paths(self.m, self.text, [u], self.first)):
                    out[i] = can
            return out
        for i, u in enumerate(self.enter):
            back = _paths(self.m, self.text, [u], self.hi)
            out[i] = [0.0 if v in back else NO for v in self.leave]
        return out

    def ids(self, enter: int, leave: int) -> bytes:
        """Ids of the units that start in the chunk, on the path between two states."""
        u, v = self.enter[enter], self.leave[leave]
        pack = lambda units: np.array(
            [x for a, b in units if a >= self.lo and b > a for x in self.m.alone(self.text[a:b])], np.uint16
        ).tobytes()
        if not self.seam:
            return pack(_chain(_paths(self.m, self.text, [u], self.hi), v))
        back = _paths(self.m, self.text, [u], self.first)
        head = _chain(back, next(x for x in back if x[1] == self.first))
        tail = _chain(_paths(self.m, self.text, [(self.last, self.last)], self.hi), v)
        middle = split_words(self.text[self.first : self.last])
        known = self.m.words(middle)
        return pack(head) + b"".join([known[w] for w in middle]) + pack(tail)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(mats: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """States at the cuts between chunks on one best path: products up, states down."""
    if len(mats) < 2:
        return []
    pairs = [times(mats[i], mats[i + 1]) if i + 1 < len(mats) else mats[i] for i in range(0, len(mats), 2)]
    ends = [enter, *states(pairs, enter, leave), leave]
    out: list[int] = []
    for k in range(len(pairs)):
        if 2 * k + 1 < len(mats):
            out.append(int(np.argmax(mats[2 * k][ends[k]] + mats[2 * k + 1][:, ends[k + 1]])))
        if k + 1 < len(pairs):
            out.append(ends[k + 1])
    return out


def all_states(mats: list[np.ndarray]) -> list[int]:
    """States at all cuts, the text's own start and end included."""
    product = mats
    while len(product) > 1:
        product = [times(product[i], product[i + 1]) if i + 1 < len(product) else product[i] for i in range(0, len(product), 2)]
    leave = int(np.argmax(product[0][0]))
    return [0, *states(mats, 0, leave), leave]


def encode(m: Model, text: str) -> bytes:
    """Packed uint16 ids of one text, chunk by chunk if it is giant."""
    text = marked(text)
    if len(text) <= GIANT:
        words = split_words(text)
        known = m.words(words)
        return b"".join([known[w] for w in words])
    chunks = [Chunk(m, *c) for c in cut(text)]
    ends = all_states([c.matrix() for c in chunks])
    return b"".join(c.ids(ends[i], ends[i + 1]) for i, c in enumerate(chunks))


def _result(m: Model, ids: bytes) -> tuple[int, int, bytes]:
    got = np.frombuffer(ids, np.uint16)
    return len(got), zlib.crc32(got.astype("<u4").tobytes()), m.decode(got)[1:].tobytes()


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of batches that hold about a megabyte of text, so that little is held beside them."""
    for batch in batches:
        for lo, hi in textbuf.slices(batch.column(column)):
            yield batch.slice(lo, hi - lo)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid, n_pieces, ids_crc32 (of 32-bit ids), decoded (the text again).

    Giant texts become rows of chunks: their matrices are worked out in parallel, the
    states at the cuts are solved per document (a matrix is far smaller than its
    chunk), and chunks are traced back in parallel.  Null is the empty text, with no
    pieces; rows stay as they are; a space mark in a text decodes to a space; extra columns
    are ignored; the table may be empty.
    """
    base = documents(docs, id_col, text_col)
    size = F.length("text")
    out = "doc_id long, uid long, n_pieces long, ids_crc32 long, decoded string"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in _small(batches, "text"):
            done = [_result(m, encode(m, t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("uid"), pa.array([x[0] for x in done], pa.int64()),
                    pa.array([x[1] for x in done], pa.int64()), pa.array([x[2].decode() for x in done], pa.string()),
                ],
                ["doc_id", "uid", "n_pieces", "ids_crc32", "decoded"],
            )

    small = base.filter(size < GIANT).select("doc_id", "uid", "text").mapInArrow(plain, out)

    parts = ("before", "chunk", "after")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in _small(batches, "chunk"):
            mats = [Chunk(m, *x).matrix() for x in zip(*(batch.column(c).to_pylist() for c in parts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"), batch.column("at"), pa.array([(x == 0).tobytes() for x in mats], pa.binary()),
                    pa.array([x.shape[1] for x in mats], pa.int32()),
                ],
                ["uid", "at", "matrix", "width"],
            )

    def solved(key, table):
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # repeated rows count once
        cells, width = table.column("matrix").to_pylist(), table.column("width").to_pylist()
        mats = [np.where(np.frombuffer(cells[i], bool).reshape(-1, width[i]), 0.0, NO) for i in first.tolist()]
        ends = np.array(all_states(mats), np.int32)
        uid = pa.array([key[0].as_py()] * len(first), pa.int64())
        return pa.table({"uid": uid, "at": at[first], "enter": ends[:-1], "leave": ends[1:]})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in _small(batches, "chunk"):
            cols = [batch.column(c).to_pylist() for c in (*parts, "enter", "leave")]
            ids = [Chunk(m, a, b, c).ids(x, y) for a, b, c, x, y in zip(*cols)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "uid", "at")), pa.array(ids, pa.binary())], ["doc_id", "uid", "at", "ids"]
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in (b.slice(lo, 16) for b in batches for lo in range(0, b.num_rows, 16)):  # of giant texts
            done = [_result(m, b"".join(x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("uid"), pa.array([x[0] for x in done], pa.int64()),
                    pa.array([x[1] for x in done], pa.int64()), pa.array([x[2].decode() for x in done], pa.string()),
                    batch.column("n_rows"),
                ],
                ["doc_id", "uid", "n_pieces", "ids_crc32", "decoded", "n_rows"],
            )

    text = F.concat(F.lit(MARK), F.replace("text", F.lit(" "), F.lit(MARK)))
    giant = base.filter(size >= GIANT).select("doc_id", "uid", text.alias("text"))
    last = F.floor((F.length("text") - 1) / CHUNK).cast("int")
    chunks = giant.select("doc_id", "uid", "text", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    begin = F.col("at") * CHUNK + 1
    held = F.least(F.col("at") * CHUNK, F.lit(REACH))
    kept = chunks.select(
        "doc_id", "uid", "at", F.substring("text", begin - held, held).alias("before"),
        F.substring("text", begin, F.lit(CHUNK)).alias("chunk"), F.substring("text", begin + CHUNK, F.lit(REACH)).alias("after"),
    ).repartition("uid", "at")
    mats = kept.mapInArrow(matrices, "uid long, at int, matrix binary, width int")
    cuts = mats.groupBy("uid").applyInArrow(solved, "uid long, at int, enter int, leave int")
    pieces = kept.join(cuts, ["uid", "at"]).mapInArrow(traced, "doc_id long, uid long, at int, ids binary")
    in_order = F.transform(F.array_sort(F.collect_set(F.struct("at", "ids"))), lambda x: x.ids)
    whole = pieces.groupBy("doc_id", "uid").agg(in_order.alias("ids"), F.sum(F.when(F.col("at") == 0, 1)).alias("n_rows"))
    large = whole.mapInArrow(joined, f"{out}, n_rows long")
    large = large.select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("_row")).drop("_row", "n_rows")
    return small.unionByName(large)
