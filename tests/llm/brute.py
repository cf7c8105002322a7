"""Plain-Python versions of the operators for small tables."""

from __future__ import annotations

import re


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text: str | None, n: int = 5) -> set:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def components(nodes: list, links) -> dict:
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_duplicates(rows: list[tuple]) -> dict:
    """``{doc_id: (n_shingles, component_id)}`` by comparing every pair that shares a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    holders: dict = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components(list(sets), links)
    return {d: (len(s), label[d]) for d, s in sets.items()}


def repeated_windows(rows: list[tuple], size: int = 50) -> set:
    """``(doc_id, start, smallest doc_id)`` of every window that several documents have."""
    holders: dict = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - size + 1):
                holders.setdefault(tuple(w[i : i + size]), []).append((d, i))
    return {(d, i, min(h)[0]) for h in holders.values() if len({d for d, _ in h}) > 1 for d, i in h}
