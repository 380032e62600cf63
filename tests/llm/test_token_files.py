"""Grammars of token files: exact expansion, random access, pairs that are left."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stepwell.llm import pieces, token_files
from stepwell.llm.common import shared_dir
from stepwell.llm.queries import tokenizer_file


def row_of(g: token_files.Grammar) -> dict:
    return {
        "terminals": g.terminals.tobytes(), "rules": g.rules.tobytes(), "lengths": g.lengths().tobytes(),
        "symbols": g.symbols.tobytes(), "doc_symbols": g.ends.tolist(),
    }


@pytest.mark.parametrize("kind", ["random", "runs", "phrases", "empty documents", "none"])
def test_grammars_expand_to_their_documents(kind):
    rng = np.random.default_rng(len(kind))
    if kind == "random":
        docs = [rng.integers(0, 50_000, rng.integers(1, 300)) for _ in range(60)]
    elif kind == "runs":
        docs = [np.full(n, 7) for n in (1, 2, 3, 5000, 64)] + [np.tile([1, 2], 700), np.tile([1, 2, 1], 50)]
    elif kind == "phrases":
        phrases = [rng.integers(0, 40, rng.integers(2, 12)) for _ in range(25)]
        docs = [np.concatenate([phrases[i] for i in rng.integers(0, 25, rng.integers(1, 40))]) for _ in range(200)]
    else:
        docs = [np.zeros(0, np.int64)] * (3 if kind != "none" else 0) + ([np.arange(5), np.zeros(0, np.int64), np.arange(5)] if kind != "none" else [])
    ids = np.concatenate(docs or [np.zeros(0)]).astype(np.uint32)
    g = token_files.compress(ids, np.cumsum([len(d) for d in docs]).astype(np.int64))
    shard = token_files.Shard(row_of(g))
    assert (shard.ids() == ids).all()
    for d, want in enumerate(docs):
        for _ in range(5):
            lo, hi = sorted(rng.integers(0, len(want) + 1, 2).tolist())
            assert shard.tokens(d, lo, hi).tolist() == want[lo:hi].tolist()
        assert shard.tokens(d, 0, len(want)).tolist() == want.tolist()
    if kind == "phrases":
        left, begin = Counter(), 0
        for end in g.ends.tolist():
            own = g.symbols[begin:end].tolist()
            left.update(zip(own, own[1:]))
            begin = end
        assert max(left.values(), default=0) < 2 * token_files.LEAST
        assert len(g.symbols) < len(ids) / 4


def test_files_give_any_range_of_a_document(spark):
    rows = [(i, f"The quick brown fox {i} jumps over the lazy dog. " * (i % 7)) for i in range(60)] + [(None, "last"), (3, None), (3, None)]
    path = f"{shared_dir(spark)}/access"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, tokenizer_file("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ordered = sorted(((d is None, d or 0, t or "") for d, t in rows))
    want = sorted((d, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for _, d, t in ordered)
    got = []
    for r in spark.read.parquet(path).collect():
        shard = token_files.Shard(r.asDict())
        for k, (doc, n) in enumerate(zip(r.doc_ids, r.doc_tokens)):
            whole = shard.tokens(k, 0, n).tolist()
            assert all(shard.tokens(k, a, b).tolist() == whole[a:b] for a, b in ((0, 1), (n // 2, n), (n // 3, n // 2)))
            got.append((doc or 0, whole))
    assert sorted(got) == want


def test_pieces_are_looked_up_once(monkeypatch):
    """Whole texts are encoded as the library does, while no piece of a slice is looked up twice."""
    vocab = pieces.Vocabulary(tokenizer_file("byte_bpe_50k.json"))
    texts = ["the cat, the cat\nthe  cat", "", None, "été the été the", "\n\n x\n", "the cat"]
    asked, find = [], vocab.look_up
    monkeypatch.setattr(vocab, "look_up", lambda parts, make, **options: asked.extend(parts) or find(parts, make, **options))
    data, n = token_files._encode(vocab, pa.array(texts, pa.string()), 0, len(texts), 0, True)
    want = [x + [0] for x in vocab.encode([t or "" for t in texts])]
    assert np.frombuffer(data, np.uint16).tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    assert len(asked) == len(set(asked))
