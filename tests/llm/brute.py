"""Plain, slow versions of what the operators compute."""

from __future__ import annotations

import collections
import re

SPACE = r"[^\x20\x09-\x0d]+"
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    return re.findall(SPACE, (text or "").translate(FOLD) if lower else (text or ""))


def shingle_set(text):
    w = words(text, True)
    if not w:
        return set()
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)}


def near_groups(docs):
    """doc_id -> smallest id of its component, for (doc_id, text) rows."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def without_repeats(docs, width=50):
    """doc_id -> (words, kept words)."""
    first = {}
    own = {i: words(t) for i, t in docs}
    for i in sorted(own):
        for k in range(len(own[i]) - width + 1):
            first.setdefault(tuple(own[i][k : k + width]), i)
    out = {}
    for i, w in own.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (w, [x for j, x in enumerate(w) if j not in gone])
    return out


def spans(text, patterns, valid):
    """(start, kind, end) of all matches that are valid, per kind leftmost and apart."""
    found = []
    for k, (name, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            if valid(name, m):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def contamination(docs, items):
    """(doc_id, item_id) -> best similarity of any window of the item's length, from 0.75."""

    def shingles(w):
        return collections.Counter(zip(*[w[k:] for k in range(5)], strict=False))

    out = {}
    parts = {i: words(t, True) for i, t in items}
    for d, text in docs:
        w = words(text, True)
        for i, item in parts.items():
            if len(item) < 5:
                continue
            own, best = shingles(item), 0.0
            for k in range(max(1, len(w) - len(item) + 1)):
                c = shingles(w[k : k + len(item)])
                shared = sum((c & own).values())
                total = sum(c.values()) + sum(own.values()) - shared
                best = max(best, shared / total)
            if best >= 0.75:
                out[d, i] = best
    return out
