"""Secret scans: all rules in one automaton, one pass over the bytes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepwell.llm import automaton, textbuf
from stepwell.llm.common import documents

#: kind, pattern, least length of the value after the separator, least length in all.
#: Lengths are checked on whole matches, which keeps counters out of the automaton.
#: The first three are the base kinds; the others are public token formats.  Every rule
#: with an open end about doubles the states, since it may be under way beside the others.
RULES = (
    ("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6, 0),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("forge", "(?:gh[opsru]_|github_pat_|glpat-)[A-Za-z0-9_-]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("chat", "xox[abeprs]-[A-Za-z0-9-]+", 0, 20),
    ("payment", "[rs]k_(?:live|test)_[0-9A-Za-z]+", 0, 24),
)


def _value_length(match: bytes) -> int:
    """Length of the value: what follows the first separator, blanks and a quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


class Scanner:
    """Rules compiled once; sent to the tasks as transition arrays."""

    def __init__(self, rules=RULES) -> None:
        self.rules = rules
        self.automaton = automaton.RuleSet([r[1] for r in rules])

    def spans(self, buf: np.ndarray, row_start: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """row -> (start, rule, end) in bytes of the row."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        rule, start, end = self.automaton.spans(buf)
        value, whole = (np.array([r[k] for r in self.rules])[rule] for k in (2, 3))
        long = end - start >= whole
        rows = np.searchsorted(row_start, start, side="right") - 1
        for row, r, s, e, least in zip(*(x[long].tolist() for x in (rows, rule, start, end, value))):
            if not least or _value_length(buf[s:e].tobytes()) >= least:
                base = int(row_start[row])
                found.setdefault(row, []).append((s - base, r, e - base))
        return found


@functools.cache
def standard() -> Scanner:
    return Scanner()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid, spans: array of (kind, start, end), code points, end exclusive.

    Spans are sorted by start, then by rule; those of one kind do not overlap.  Null and
    empty texts have none.  Rows stay as they are, repeated ones and null ids included;
    extra columns are ignored; the table may be empty.
    """
    scanner = standard()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r[0] for r in scanner.rules]
        for batch in batches:
            text, out = batch.column("text"), []
            for lo, hi in textbuf.slices(text):
                buf, row_start, row_end = textbuf.buffer(text, lo, hi)
                rows: list[list] = [[] for _ in range(hi - lo)]
                for row, got in scanner.spans(buf, row_start).items():
                    a = int(row_start[row])
                    part = buf[a : int(row_end[row])]
                    heads = np.cumsum((part & 0xC0) != 0x80) if (part >= 0x80).any() else None
                    point = (lambda i: i) if heads is None else (lambda i: int(heads[i - 1]) if i else 0)
                    rows[row] = [
                        {"kind": kinds[r], "start": point(s), "end": point(e)} for s, r, e in sorted(got)
                    ]
                out.extend(rows)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), pa.array(out, kind)], ["doc_id", "uid", "spans"]
            )

    schema = "doc_id long, uid long, spans array<struct<kind:string, start:long, end:long>>"
    return documents(docs, id_col, text_col).select("doc_id", "uid", "text").mapInArrow(run, schema)
