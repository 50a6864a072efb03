"""Plain reference implementations that the tests compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = r"[^\x20\x09-\x0D]+"


def repeats(rows, size=100):
    """doc_id -> (bytes, removed, spans, sha256 of the rest); rows of equal id and text are one document."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p:p + size]
            if w in seen:
                gone[p:p + size] = b"\1" * size
            seen.add(w)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, text] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text, words):
    tokens = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    grams = [" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    """Least id reachable, for (id, fingerprint) rows."""
    group = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    return group


def base_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def longest_matches(text: bytes, sample: bytes):
    """Phrases of the greedy parse of a text against a sample."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at:at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def top_segments(scores):
    """All maximal scoring segments by repeatedly splitting at the best one."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best[0] + 1e-12:
                best = (total, i, j + 1)
    if best[0] <= 0:
        return []
    _, i, j = best
    return [*top_segments(scores[:i]), (i, j, best[0]), *[(a + j, b + j, s) for a, b, s in top_segments(scores[j:])]]
