"""Plain versions of the operators, straight from their definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

GAP = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near_groups(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> n_shingles, component_id, kept."""
    sets = {}
    for doc, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def cut_repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def maximal_repeats(docs: list[tuple[int, str | None]], length: int = 100) -> set[tuple[bytes, int, int]]:
    """(string, doc_id, start) of every occurrence of every maximal repeat: the strings of pairs of places that differ, or end, on both sides."""
    raws = {d: (t or "").encode() for d, t in docs}
    places = defaultdict(list)
    for d, raw in raws.items():
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((d, i))
    strings = set()
    for at in places.values():
        for k, (d, i) in enumerate(at):
            for e, j in at[:k]:
                a, b = raws[d], raws[e]
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                n = length
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                strings.add(a[i : i + n])
    return {(w, d, i) for w in strings for d, i in places[w[:length]] if raws[d][i : i + len(w)] == w}

