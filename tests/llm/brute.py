"""Plain-Python answers for small fixtures: no code of the operators is used here."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def token_files(rows, tokenizer):
    """doc_id -> (start, n_tokens, crc32), ids end with 0."""
    out, start = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)"""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    found.sort(key=lambda s: (s[1], kinds.index(s[0])))
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*[sum(s[0] == k for s in found) for k in kinds], sha(said))


def fingerprint(text) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    k = min(4, len(words))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(rows, radius: int = 4):
    """doc_id -> (fingerprint, least doc_id reachable), by all pairs of distinct fingerprints."""
    prints = {d: fingerprint(t) for d, t in rows}
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    least = {}
    for d, f in prints.items():
        least[top(f)] = min(d, least.get(top(f), d))
    return {d: (f"{f:016x}", least[top(f)]) for d, f in prints.items()}


def nearest(rows, k: int = 20, step: int = 20):
    """query_id -> [(vec_id, score)] by exact inner products."""
    good = {}
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.array(v, "float64")
    ids = sorted(good)
    matrix = np.array([good[i] for i in ids])
    out = {}
    for q in ids:
        if q % step == 0:
            scores = matrix @ good[q]
            near = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def repeats(rows, width: int = 50):
    """doc_id -> (n_words, n_removed, kept)."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(d, first.get(g, d))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), " ".join(kept))
    return out


BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def leaks(docs, items, width: int = 10):
    """doc_id -> (n_words, n_hit, sorted item names)."""
    grams = {}
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = {}
    for d, text in docs:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in grams:
                    hit.update(range(i, i + m))
                    names |= grams[tuple(w[i : i + m])]
        out[d] = (len(w), len(hit), sorted(names))
    return out


def jaccard_components(rows, width: int = 3):
    """doc_id -> (set size, least doc_id reachable), by all pairs of distinct sets."""
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(width, len(w))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()
    distinct = sorted({s for s in sets.values() if s}, key=len)
    parent = {s: s for s in distinct}

    def top(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a) < 90 * len(b):
                break
            both = len(a & b)
            if 100 * both >= 90 * (len(a) + len(b) - both):
                parent[top(a)] = top(b)
    least = {}
    for d, s in sets.items():
        if s:
            least[top(s)] = min(d, least.get(top(s), d))
    return {d: (len(s), least[top(s)] if s else d) for d, s in sets.items()}


def clusters(rows, k: int = 16, rounds: int = 3, dim: int = 64):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [int(x) * 64 if abs(x) > 2**53 else math.floor(64 * x) for x in v]))
    starts = sorted((sha(f"1:{i}"), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in starts]
    if not centres:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, own in groups.items():
            centres[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    totals = {}
    for _, d, c in found:
        totals[c] = totals.get(c, 0) + d
    most = (1 << 63) - 1
    out = [(i, c, min(d, most), min(totals[c], most), min(sum(totals.values()), most), sha(",".join(map(str, centres[c])))) for i, d, c in found]
    return sorted(out, key=repr)


def edits(word: str, letters: str):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b}
    out |= {a + c + b[1:] for a, b in cuts if b for c in letters}
    out |= {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def spellings(rows, every: int = 199, rarest: int = 5):
    """word -> (n, n_near, form, form_n, root)."""
    counts = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= rarest}
    letters = "".join(sorted({c for w in counts for c in w}))
    out = {}
    for w, n in counts.items():
        near = [x for x in edits(w, letters) if x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [n, len(near), form, counts.get(form), w]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w][4] = root
    return {w: tuple(v) for w, v in out.items()}
