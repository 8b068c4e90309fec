"""Plain counterparts of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def component_ids(texts: dict[int, str | None]) -> dict[int, int]:
    """Smallest id reachable over links of similarity 0.8, all pairs that share a shingle compared."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    common = Counter()
    for ids in having.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def without_repeats(texts: list[bytes], length: int = 100) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, sha256 of what stays, of texts in the order of their ids."""
    seen, out = set(), []
    for text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


class Trie:
    """Prediction by partial matching, one symbol at a time: method D with exclusion."""

    def __init__(self, texts: list[bytes], order: int):
        self.order = order
        self.follow: dict[bytes, Counter] = defaultdict(Counter)
        for text in texts:
            data = b"\xfe" * order + text.lower() + b"\xff"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.follow[data[i - k : i]][data[i]] += 1

    def symbol(self, context: bytes, symbol: int) -> float:
        out, ruled_out = 0.0, set()
        for k in range(self.order, -1, -1):
            here = {s: n for s, n in self.follow.get(context[len(context) - k :], {}).items() if s not in ruled_out}
            if not here:
                continue
            total = 2 * sum(here.values())
            if symbol in here:
                return out + math.log10((2 * here[symbol] - 1) / total)
            out += math.log10(len(here) / total)
            ruled_out |= set(here)
        return out - math.log10(256 - len(ruled_out))

    def text(self, text: bytes) -> float:
        data = b"\xfe" * self.order + text.lower() + b"\xff"
        return sum(self.symbol(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))
