"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix(rows: list[tuple[int, str | None]], length: int = 400) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256); rows must have distinct ids."""
    seen: Counter[bytes] = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[x : x + length] for x in range(len(b) - length + 1))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if seen[b[x : x + length]] > 1:
                gone[x : x + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def windows13(rows: list[tuple[int, str | None]], n: int = 13) -> dict:
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first: dict[tuple, int] = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for x in range(len(w) - n + 1):
            key = tuple(w[x : x + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split:
        gone = [False] * len(w)
        for x in range(len(w) - n + 1):
            if first[tuple(w[x : x + n])] < i:
                gone[x : x + n] = [True] * n
        kept = [a for a, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), sha(" ".join(kept).encode()))
    return out


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(low)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(rows: list[tuple[int, str | None]]) -> dict:
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both: Counter[tuple[int, int]] = Counter()
    for ids in by.values():
        ids = sorted(ids)
        both.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i)) for i, s in sets.items()}
