"""Spelling variants of words: forward and backward minimal acyclic automata.

Two words that differ by one code point share the first half of the shorter one, or else its
second half.  Words are dealt out by length and half, once by the first half and once by the
second, read backwards.  Each deal is cut into runs of bounded size; a run's words become one
minimal acyclic automaton whose states know how many words lie behind them, so a walk that
ends in a word also gives its number in sorted order (a perfect hash).  A word is looked up by
walking its half exactly and completing the rest with exactly one error.  A pair that shares
both halves is left to the forward deal, so no pair is found twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import discard, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Code points of a text taken at a time, and distinct words counted before they are passed on.
PIECE, HELD = 1 << 20, 200_000
#: Words of one automaton.
WORDS = 20_000


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about a million code points, cut where no word goes on."""
    at = 0
    while len(text) - at > PIECE:
        cut = _LETTER.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def misspelt(doc_id, run: str, every: int) -> str:
    """The lower-cased run, without one code point where the hash of both says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """word, n: runs counted in tasks, then over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id = doc_id.as_py()
                for piece in _pieces(text.as_py() or ""):
                    runs: Counter = Counter()
                    for run, n in Counter(RUN.findall(piece)).items():
                        runs[_lower(run)] += n
                    for run, n in runs.items():
                        held[misspelt(doc_id, run, every)] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words; a word's number is its place."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path = [0]  # states of the last word that may still grow
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                key = (self.final[state], tuple(self.edges[state].items()))
                self.edges[path[-1]][last[len(path) - 1]] = known.setdefault(key, state)

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(shared)
            for c in word[shared:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][c] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)
        self._number()

    def _number(self) -> None:
        """Words behind each state, and for each edge those that come before it there."""
        behind: dict[int, int] = {}
        self.steps: list[dict[str, tuple[int, int]]] = [{} for _ in self.edges]
        todo = [0]
        while todo:
            state = todo[-1]
            waiting = [s for s in self.edges[state].values() if s not in behind]
            if waiting:
                todo.extend(waiting)
                continue
            todo.pop()
            before = int(self.final[state])
            for c, to in self.edges[state].items():  # in sorted order, as words came
                self.steps[state][c] = (to, before)
                before += behind[to]
            behind[state] = before
        self.edges = []

    def _exact(self, state: int, number: int, rest: str) -> int | None:
        for c in rest:
            step = self.steps[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return number if self.final[state] else None

    def one_error(self, word: str, half: int) -> set[int]:
        """Numbers of the words that share the first ``half`` code points and differ by one error."""
        state, number, found = 0, 0, set()
        for c in word[:half]:
            step = self.steps[state].get(c)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        for i in range(half, len(word) + 1):
            here = word[i] if i < len(word) else None
            if here is not None:
                found.add(self._exact(state, number, word[i + 1 :]))  # one deleted
            for c, (to, more) in self.steps[state].items():
                if c != here:
                    if here is not None:
                        found.add(self._exact(to, number + more, word[i + 1 :]))  # one replaced
                    found.add(self._exact(to, number + more, word[i:]))  # one inserted
            step = self.steps[state].get(here) if here is not None else None
            if step is None:
                break
            state, number = step[0], number + step[1]
        found.discard(None)
        return found


def _shared(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


class _Lookup:
    """One automaton over dealt words, and its answers to queries."""

    def __init__(self, words: dict[str, int], backward: bool):
        self.words, self.backward = words, backward
        read = {w[::-1]: w for w in words} if backward else {w: w for w in words}
        self.order = sorted(read)
        self.automaton = Automaton(self.order)
        self.read = read

    def pairs(self, queries: list[tuple[int, str, str, int]]) -> pa.RecordBatch:
        """(size, half, word, n) -> pairs whose shorter word has that size."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        for size, half, word, n in queries:
            for number in self.automaton.one_error(word[::-1] if self.backward else word, len(half)):
                near = self.read[self.order[number]]
                if near == word or min(len(word), len(near)) != size:
                    continue
                if self.backward and _shared(word, near) >= size // 2:
                    continue  # the forward deal finds it
                for column, value in zip(out, (word, n, near, self.words[near])):
                    column.append(value)
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["word", "n", "near", "near_n"])


def _near(backward: bool):
    """Rows sorted by (size, half, part, member first) -> pairs of near words.

    Halves of part 0 are taken together until an automaton is full: their words are members
    and queries in one.  A part of a hot half has its members first; its queries stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        asked: list[tuple[int, str, str, int]] = []
        lookup, last = None, None
        for batch in batches:
            for size, half, part, member, word, n in zip(*(batch.column(c).to_pylist() for c in ("size", "half", "part", "member", "word", "n"))):
                key = (size, half, part)
                if last and key != last and (part or last[2] or len(words) >= WORDS):
                    yield (lookup or _Lookup(words, backward)).pairs(asked)
                    words, asked, lookup = {}, [], None
                last = key
                if member:
                    words[word] = n
                if not member or not part:
                    asked.append((size, half, word, n))
                if part and len(asked) >= WORDS:
                    lookup = lookup or _Lookup(words, backward)
                    yield lookup.pairs(asked)
                    asked = []
        if asked:
            yield (lookup or _Lookup(words, backward)).pairs(asked)

    return run


def _dealt(words: DataFrame, backward: bool, shortest: int, most: int) -> DataFrame:
    """size, half, part, member, word, n: every word for its own length and the one below.

    Where more than ``most`` words share length and half, the words of the automaton are dealt
    to parts and every word asks all of them.
    """
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    half = F.reverse(F.expr("right(word, size - size div 2)")) if backward else F.expr("left(word, size div 2)")
    rows = words.select("word", "n", size).filter(F.col("size") >= shortest).withColumn("half", half)
    hot = materialise(rows.groupBy("size", "half").agg(F.count("*").alias("c")).filter(F.col("c") > most), "hot")
    if not hot.take(1):
        return rows.select("size", "half", F.lit(0).alias("part"), F.lit(True).alias("member"), "word", "n")
    rows = rows.join(hot, ["size", "half"], "left").withColumn("parts", F.ceil(F.col("c") / most).cast("int"))
    cool = rows.filter("c IS NULL").select("size", "half", F.lit(0).alias("part"), F.lit(True).alias("member"), "word", "n")
    rows = rows.filter("c IS NOT NULL")
    own = (F.pmod(F.xxhash64("word"), "parts") + 1).cast("int")
    members = rows.select("size", "half", own.alias("part"), F.lit(True).alias("member"), "word", "n")
    part = F.explode(F.sequence(F.lit(1), "parts")).alias("part")
    return cool.union(members).union(rows.select("size", "half", part, F.lit(False).alias("member"), "word", "n"))


def near_words(words: DataFrame, shortest: int = 6, most: int = WORDS) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words one error apart, each once.

    ``words`` has distinct words of ``shortest`` code points or more, and their counts.
    """
    found = None
    for backward in (False, True):
        dealt = _dealt(words, backward, shortest, most).repartition("size", "half", "part")
        dealt = dealt.sortWithinPartitions("size", "half", "part", F.desc("member"))
        part = dealt.mapInArrow(_near(backward), "word string, n long, near string, near_n long")
        found = part if found is None else found.union(part)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, by pointer doubling; only words that have a form.

    A form is several times as frequent as its word, so chains are short, and k rounds follow 2^k steps.
    """
    now = materialise(forms, "forms")
    while True:
        onward = now.select(F.col("word").alias("form"), F.col("form").alias("next"))
        after = materialise(now.join(onward, "form", "left").select("word", F.coalesce("next", "form").alias("form")), "forms")
        moved = after.join(now, ["word", "form"], "left_anti").take(1)
        discard(now)
        now = after
        if not moved:
            return now.select("word", F.col("form").alias("root"))


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, shortest: int = 6, rarest: int = 5, factor: int = 5
) -> DataFrame:
    """word, n, n_near, form, form_n, root: words that may be spellings of more frequent ones.

    Words are the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts with A-Z in
    lower case, of ``shortest`` code points or more, seen ``rarest`` times or more.  Where
    ``every`` divides the crc32 of ``<doc_id>:<run>``, the run loses one code point.  A word's
    form is the near word of largest n (ties: least in code-point order) if that n is
    ``factor`` times the word's; root follows forms to the last.

    Null texts have no words; a null id is written as the empty string.  Repeated rows count
    as often as they are there; extra columns are ignored; an empty table gives no rows.
    """
    if shortest < 6:
        raise ValueError("words of fewer than six code points have halves of fewer than three")
    counts = word_counts(docs, id_col, text_col, every).filter((F.length("word") >= shortest) & (F.col("n") >= rarest))
    words = materialise(counts, "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    near = materialise(near_words(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), best), "near")
    joined = words.join(near, "word", "left")
    is_form = F.col("best.near_n") >= factor * F.col("n")
    known = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, F.col("best.near_n")).alias("form_n"),
    )
    known = materialise(known, "known")
    discard(near)
    roots = _roots(known.filter("form IS NOT NULL").select("word", "form"))
    out = known.join(roots, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
