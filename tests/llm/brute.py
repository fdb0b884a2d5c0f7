"""Plain statements of what the operators must give."""

from __future__ import annotations

import collections
import hashlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def byte_dedup(docs, width=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def word_dedup(docs, width=13):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    lists = collections.defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            lists[s].append(d)
    u = Union(sets)
    for d, own in sets.items():
        for x, n in collections.Counter(x for s in own for x in lists[s] if x < d).items():
            if 100 * n >= 75 * (len(own) + len(sets[x]) - n):
                u.join(d, x)
    return sorted((d, len(s), u.find(d)) for d, s in sets.items())


def vector_links(rows, threshold=0.93):
    """rows: (id, vector or None, label)."""
    ok = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        x = x / np.abs(x).max()
        ok[i] = (x / np.linalg.norm(x), label)
    u, links = Union([r[0] for r in rows]), collections.Counter()
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, p), (y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and float(x @ y) >= threshold:
                u.join(a, b)
                links[a] += 1
                links[b] += 1
    return sorted((i, links[i], u.find(i), u.find(i) == i) for i in {r[0] for r in rows})
