"""Plain, slow versions of the operators."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    low = {}
    for n in nodes:
        low[find(n)] = min(low.get(find(n), n), n)
    return {n: low[find(n)] for n in nodes}


def shingle_set(text, size):
    words = (text or "").translate(LOWER).encode().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def ngram_join(rows, size, threshold):
    sets = [shingle_set(t, size) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                links.append((i, j))
    known = [i for i in range(len(rows)) if rows[i][0] is not None]
    group = components(known, [(i, j) for i, j in links if i in known and j in known])
    low = defaultdict(lambda: None)
    for i in known:
        g = group[i]
        low[g] = rows[i][0] if low[g] is None else min(low[g], rows[i][0])
    return [(rows[i][0], len(sets[i]), low[group[i]] if i in group else None) for i in range(len(rows))]


def substring_dedup(texts, size):
    split = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[k : k + size]) for w in split for k in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out.append((b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
