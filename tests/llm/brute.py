"""The operators' contracts, worked out plainly on small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text: str | None) -> int:
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [words[i:i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows) -> set:
    """rows: (doc_id, text) with distinct ids."""
    fps = {d: simhash(t) for d, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 3]
    found = components(pairs, ids)
    return {(d, f"{fps[d]:016x}", found[d]) for d in ids}


def repeats(rows, size: int = 20) -> set:
    first: dict = {}
    docs = {d: SPACE.findall(t or "") for d, t in rows}
    for d in sorted(docs):
        for i in range(len(docs[d]) - size + 1):
            first.setdefault(tuple(docs[d][i:i + size]), (d, i))
    out = set()
    for d, words in docs.items():
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i:i + size])] != (d, i):
                gone |= set(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.add((d, len(words), len(gone), sha(kept)))
    return out


def contamination(rows, items, size: int = 10) -> set:
    windows: dict = {}
    for item, text in items:
        words = NORMAL.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = set()
    for d, text in rows:
        words, hit, names = NORMAL.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i:i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.add((d, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out
