"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import re

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base_figures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = WORDS.findall(t)
    windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def shingles(text: str | None) -> frozenset:
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def jaccard_components(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) of each row; ids may repeat."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
        for g in s:
            holders[g].append(k)
    least: dict[int, int] = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            least[find(k)] = min(least.get(find(k), name), name)
    return [(name, len(s), least.get(find(k), name)) for k, ((name, _), s) in enumerate(zip(rows, sets, strict=True))]


def window_dedup(rows: list[str | None], window: int) -> list[tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans, kept bytes of each text."""
    bodies = [(t or "").encode() for t in rows]
    seen = collections.Counter(b[p : p + window] for b in bodies for p in range(len(b) - window + 1))
    out = []
    for b in bodies:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                cover[p] += 1
                cover[p + window] -= 1
        hit = np.cumsum(cover)[: len(b)] > 0
        spans = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(hit) else 0
        out.append((len(b), int(hit.sum()), spans, np.frombuffer(b, np.uint8)[~hit].tobytes()))
    return out


def edit_distance_within(item: str, text: str) -> int:
    """Least edit distance of the item to any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a != b)))
    return min(row)


def jump(key: int, shards: int) -> int:
    at, then, state = -1, 0, key % (1 << 64)
    while then < shards:
        at = then
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        then = int((at + 1) * ((1 << 31) / ((state >> 33) + 1)))
    return at


def merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def spread_lines(rows: list[tuple[int, str | None, str | None]], sites: int) -> list[str | None]:
    """Texts (id, text, source) without lines on so many sources, but where the id is the smallest."""
    where, first = collections.defaultdict(set), {}
    for name, text, site in rows:
        for x in (text or "").split("\n"):
            if WORDS.search(x):
                if site is not None:
                    where[x].add(site)
                if name is not None:
                    first[x] = min(first.get(x, name), name)
    out = []
    for name, text, _ in rows:
        if text is None or name is None:
            out.append(text)
            continue
        out.append("\n".join(x for x in text.split("\n") if not (WORDS.search(x) and len(where[x]) >= sites and name > first[x])))
    return out
