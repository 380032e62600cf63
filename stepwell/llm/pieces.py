"""Texts cut at boundaries where a tokenizer's result is the sum of its parts'.

All boundaries are found with numpy on the bytes of a batch.  For tokenizers that
split on white space, letters, digits and other characters before merging:

* between an ASCII letter and one of ``.,!?;:()`` (either order): no contraction
  rule, no run of letters and no run of other characters crosses it;
* ``dropped``: at ASCII white space, for tokenizers that drop it;
* ``leading``: before one single space or newline between two other characters, and
  behind such a newline, for byte-level tokenizers where a space leads the next piece.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from stepwell.llm import textbuf

#: Bytes of pieces that are remembered from one call to the next.
LONG = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,!?;:()")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(range(0x09, 0x0E)) + list(range(0x1C, 0x21))] = True
_WIDE = np.zeros(256, bool)  # first bytes of the white space beyond ASCII, and of much else
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _points(buf: np.ndarray) -> np.ndarray:
    """Mask over the gaps between byte i and i + 1."""
    letter, point = _LETTER[buf], _POINT[buf]
    return (letter[:-1] & point[1:]) | (point[:-1] & letter[1:])


def dropped(buf: np.ndarray, row_start: np.ndarray, fold: bool) -> tuple[list[bytes], np.ndarray]:
    """Pieces and the first piece of each row; ``fold`` lower-cases A-Z."""
    if fold and buf.tobytes().find(b"<|") < 0:  # special strings are told apart by case
        buf = _FOLD[buf]
    cut = np.flatnonzero(_points(buf)) + 1 if len(buf) else np.zeros(0, np.int64)
    wide = np.insert(buf, cut, 32)
    starts, _ = textbuf.spans(wide)
    first = np.searchsorted(starts, row_start + np.searchsorted(cut, row_start))
    return wide.tobytes().split(), first


def leading(buf: np.ndarray, row_start: np.ndarray, row_end: np.ndarray) -> tuple[pa.Array, np.ndarray] | None:
    """Pieces as an Arrow array, no Python object each, and the first piece of each row; None if the rows hold 0x00."""
    if (buf == 0).any():
        return None
    buf = buf.copy()
    buf[row_end] = 0  # the newline after each row
    blank = _BLANK[buf]
    wide = _WIDE[buf]
    if wide.any():
        blank |= wide
        blank[1:] |= wide[:-1]
        blank[2:] |= wide[:-2]
    one = ((buf == 32) | (buf == 10))[1:-1] & ~blank[:-2] & ~blank[2:] & (buf[:-2] != 0) & (buf[2:] != 0)
    gap = _points(buf)
    gap[:-1] |= one  # gap i lies before byte i + 1
    gap[1:] |= one & (buf[1:-1] == 10)  # a newline stands alone, only a space leads a piece
    cut = np.flatnonzero(gap) + 1
    rows = np.arange(len(row_end))
    # offsets into the bytes without those newlines
    ends = np.sort(np.concatenate([cut - np.searchsorted(row_end, cut), row_end - rows]), kind="stable")
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    data = np.delete(buf, row_end)
    pieces = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces, np.searchsorted(cut, row_start) + rows


def _byte_alphabet() -> dict[int, str]:
    """Byte-level tokenizers write printable bytes as themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(others)}


class Vocabulary:
    """A tokenizer with a bounded memory of the pieces it has encoded."""

    def __init__(self, path: str, keep: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.keep = path, keep
        self.known, self.old, self.long = {}, {}, []
        if path.endswith(".model"):
            import sentencepiece

            self.model, self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path), None
        else:
            from tokenizers import Tokenizer

            self.model, self.tokenizer = None, Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self._letters()

    def _letters(self) -> None:
        """Whether a piece of letters goes to the merge model as it is, and lower-cased."""
        config = json.load(open(self.path))
        steps = config["normalizer"]
        steps = steps.get("normalizers", [steps]) if steps else []
        self.lower = any(x["type"] == "Lowercase" for x in steps)
        self.direct = {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"} and "ByteLevel" in json.dumps(config["pre_tokenizer"])
        self.alphabet, self.merge = _byte_alphabet(), self.tokenizer.model.tokenize
        self.space = self.alphabet[32]

    def _merged(self, piece: bytes):
        """Merges of a run of letters below U+0250, after a space or not; None for others."""
        core = piece[1:] if piece[:1] == b" " else piece
        if core.isalpha():  # of bytes: ASCII letters, which the byte alphabet leaves as they are
            text = core.decode()
            return self.merge((text.lower() if self.lower else text) if core is piece else self.space + text)
        text = core.decode()
        if not text.isalpha() or max(text) >= "\u0250":
            return None
        if self.lower:
            text = unicodedata.normalize("NFC", text.lower())
            if not text.isalpha():  # a dotted capital I becomes a letter and a mark
                return None
        text = text.encode().decode("latin-1").translate(self.alphabet)
        return self.merge(text if core is piece else self.space + text)

    def _each(self, pieces: list[bytes], of_tokens, of_encoding) -> list:
        if not self.direct:
            return [of_encoding(e) for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        out = [None if t is None else of_tokens(t) for t in map(self._merged, pieces)]
        rest = [i for i, x in enumerate(out) if x is None]
        got = self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, got):
            out[i] = of_encoding(e)
        return out

    def piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed uint16 ids of each piece."""
        if self.model is not None:
            return [array("H", x).tobytes() for x in self.model.encode([p.decode() for p in pieces], num_threads=1)]
        return self._each(pieces, lambda x: array("H", [t.id for t in x]).tobytes(), lambda e: array("H", e.ids).tobytes())

    def piece_lengths(self, pieces: list[bytes]) -> list[int]:
        if self.model is not None:
            return self.lengths([p.decode() for p in pieces])
        return self._each(pieces, len, len)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.model is not None:
            return self.model.encode(texts, num_threads=1)
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, texts: list[str]) -> list[int]:
        if self.model is not None:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def look_up(self, pieces: list[bytes], make, once: bool = False) -> dict:
        """Results of ``make`` (list of pieces -> list of results) for all the pieces; ``once``: no piece is repeated.

        What was not used since the memory last filled up is forgotten when it fills up again;
        pieces of more than LONG bytes are forgotten at the next call.
        """
        for p in self.long:
            self.known.pop(p, None)
        distinct = pieces if once else set(pieces)
        known, old = self.known, self.old
        if len(known) + len(distinct) > self.keep // 2:
            known, old = {}, known
            self.known, self.old = known, old
        missing = [p for p in distinct if p not in known]
        if old:
            known.update((p, old[p]) for p in missing if p in old)
            missing = [p for p in missing if p not in known]
        self.long = [p for p in missing if len(p) > LONG]
        for lo in range(0, len(missing), 4096):
            part = missing[lo : lo + 4096]
            known.update(zip(part, make(part)))
        return known


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, use: str) -> Vocabulary:
    """One per Python worker, path and use (what is remembered differs by use)."""
    if (path, use) not in _LOADED:
        _LOADED[path, use] = Vocabulary(path)
    return _LOADED[path, use]
