"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def smallest(ids, links):
    """Smallest id that is not None in the component of each position."""
    comp = roots(len(ids), links)
    least = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            least[c] = min(least.get(c, ids[i]), ids[i])
    return [least.get(c) for c in comp]


def near_duplicates(rows, percent=85):
    """rows: (id, text).  Gives (id, n_shingles, component_id, kept) of each."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for hold in holders.values():
        for a in range(len(hold)):
            for b in range(a + 1, len(hold)):
                shared[hold[a], hold[b]] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    ids = [r[0] for r in rows]
    comp = smallest(ids, links)
    return [(i, len(s), c, i is not None and i == c) for i, s, c in zip(ids, sets, comp)]


def repeats(rows, min_bytes=200):
    """rows: (id, text).  Gives (id, n_bytes, n_removed, n_spans, kept_sha256) of each."""
    data = [(t or "").encode() for _, t in rows]
    times = Counter(d[i:i + min_bytes] for d in data for i in range(len(d) - min_bytes + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - min_bytes + 1):
            if times[d[k:k + min_bytes]] > 1:
                gone[k:k + min_bytes] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def near_vectors(rows, at_least=0.98):
    """rows: (id, vector, label).  Gives (id, n_links, component_id, kept) of each."""
    links, n = [], [0] * len(rows)
    units = []
    for _, v, _ in rows:
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if units[a] is None or units[b] is None or rows[a][2] is None or rows[a][2] != rows[b][2] or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= at_least:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    ids = [r[0] for r in rows]
    comp = smallest(ids, links)
    return [(i, k, c, i is not None and i == c) for i, k, c in zip(ids, n, comp)]
