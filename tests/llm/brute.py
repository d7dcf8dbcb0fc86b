"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def op2(rows, k=35):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + k]) for _, w in texts for i in range(len(w) - k + 1))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op3(rows, size=4, percent=85):
    sets = []
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    where = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = Counter()
    for i, (_, s) in enumerate(sets):
        near = Counter(j for g in s for j in where[g] if j < i)
        for j, c in near.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                pairs[i, j] = c
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)]


def op6(rows, k=100):
    first, out = {}, []
    rows = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    for d, x in rows:
        for i in range(len(x) - k + 1):
            first.setdefault(x[i : i + k], (d, i))
    for d, x in rows:
        gone = bytearray(len(x))
        for i in range(len(x) - k + 1):
            if first[x[i : i + k]] != (d, i):
                gone[i : i + k] = b"\1" * k
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out
