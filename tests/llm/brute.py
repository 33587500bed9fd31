"""Plain Python versions of the queries' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius=2):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = list(zip(ids, prints, strict=True))
    for n, (a, x) in enumerate(pairs):
        for b, y in pairs[:n]:
            if (x ^ y).bit_count() <= radius:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


def secret_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def kept_words(docs, width=50):
    """doc_id -> (words, words kept)."""
    first = {}
    split = {i: words(t) for i, t in docs}
    for i in sorted(split):
        for at in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][at : at + width]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for at in range(len(w) - width + 1):
            if first[tuple(w[at : at + width])] < i:
                gone[at : at + width] = [True] * width
        out[i] = (len(w), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def exact_groups(docs):
    """Per row: (keep_id, size, sha)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    best = {k: (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for k, v in groups.items()}
    return [(*best[n], hashlib.sha256(n.encode()).hexdigest()) for _, t in docs for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
