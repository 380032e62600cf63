"""Spans of the combined automaton against Python regular expressions, rule by rule."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from stepwell.llm import automaton, secrets

WORDS = [
    "password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "  ", "'", '"', "\n", "abc", "hunter22", "0123456789abcdef", "deadbeef",
    "AKIA", "ABCDEFGHIJ", "ghp_", "github_pat_", "A1b2C3d4E5f6", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "AIza", "sk_live_", "npm_", "eyJ", ".", "SG.",
    "é", "\U0001f600", "-", "_", "/", "\x00",
]


def expected(rule, text: bytes):
    _, pattern, least, whole = rule
    if least:
        pattern = pattern[: pattern.rindex("[")] + "(" + pattern[pattern.rindex("[") :] + ")"
    for m in re.finditer(pattern.encode(), text):
        if len(m[0]) >= whole and (not least or len(m[m.lastindex]) >= least):
            yield m.start(), m.end()


@pytest.mark.parametrize("seed", range(6))
def test_every_rule_as_python_finds_it(seed):
    rng = random.Random(seed)
    scanner = secrets.standard()
    rows = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60))).encode() for _ in range(400)]
    rows.append(b"0123456789abcdef" * 3000)
    rows.append(b"token=" + b"A" * 20_000 + b" secret: " + b"z" * 9)
    buf = np.frombuffer(b"".join(r + b"\n" for r in rows), np.uint8)
    start = np.cumsum([0] + [len(r) + 1 for r in rows])[:-1]
    got = scanner.spans(buf, start)
    for i, text in enumerate(rows):
        # a text ends with a newline that no rule holds
        want = sorted((a, r, b) for r, rule in enumerate(secrets.RULES) for a, b in expected(rule, text))
        assert sorted(got.get(i, [])) == want, text


def test_rules_that_may_begin_with_nothing_are_refused():
    with pytest.raises(ValueError):
        automaton.compile_rules(["a*b"], anchored=False)


def test_no_bytes():
    assert secrets.standard().spans(np.zeros(0, np.uint8), np.zeros(0, np.int64)) == {}
