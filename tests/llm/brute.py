"""Plain single-process versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def near_duplicates(docs: list[tuple[int, str | None]], size: int, percent: int = 80) -> dict[int, tuple[int, int, bool]]:
    """doc_id: (n_shingles, component_id, kept), for distinct doc_ids."""
    sets = {}
    for i, t in docs:
        w = words(ascii_lower(t or ""))
        k = min(size, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            continue
        common = len(x & y)
        if 100 * common >= percent * (len(x) + len(y) - common):
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def repeated_windows(docs: list[tuple[int, str | None]], size: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id: (n_words, n_removed, kept text), for distinct doc_ids."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            if key in seen:
                gone[j : j + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], size: int = 10) -> dict[int, tuple]:
    """doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = find(t)
        if w:
            k = min(size, len(w))
            for j in range(len(w) - k + 1):
                windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = {}
    lengths = sorted({len(w) for w in windows})
    for i, t in docs:
        w, hit, ids = find(t), set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    ids |= found
        names = ",".join(sorted(str(x) for x in ids))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines, seen, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at: dict[tuple, list[int]] = {}
    for j in range(len(w) - 7):
        at.setdefault(tuple(w[j : j + 8]), []).append(j)
    inside = {j + k for js in at.values() if len(js) > 1 for j in js for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)
