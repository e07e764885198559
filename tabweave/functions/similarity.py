"""Similarity of short texts: the best window's normalised insert-delete ratio, 0 to 100."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of a longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return (~s & full).bit_count()


def partial_ratio(left: str, right: str, enough: float = 100.0) -> float:
    """The shorter text against each window of the longer one, windows cut off by an end included; any ratio from `enough` on will do."""
    short, long = sorted((left, right), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, best, letters = len(short), 0.0, set(short)
    for start in range(1 - n, len(long)):
        window = long[max(start, 0) : start + n]
        if window[-1] in letters or window[0] in letters:
            best = max(best, 200.0 * _common(short, window) / (n + len(window)))
            if best >= enough:
                break
    return best


def score(left: str, right: str, enough: float = 100.0) -> float:
    """100 if one holds the other, else the partial ratio; case does not count."""
    a, b = left.lower(), right.lower()
    return 100.0 if a in b or b in a else partial_ratio(a, b, enough)


class Matcher:
    """Tells whether a text scores `threshold` or more against one of those added, within its block.

    A ratio of the threshold leaves `2 n (1 - threshold / 100)` edits on a shorter text of n
    letters. Cut into one piece more, it has a piece that stands unchanged in the longer
    text, so only texts that share a piece are scored; no pair is lost.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.texts: list[tuple[str, Counter]] = []
        self.blocks: dict[str, list[int]] = defaultdict(list)
        self.sizes: dict[str, set[int]] = defaultdict(set)
        self.pieces: dict[tuple[str, int], dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.grams: dict[tuple[str, int], tuple[int, dict[str, list[int]]]] = {}

    def _cut(self, t: str) -> tuple[int, list[str]]:
        """Length of a piece and the pieces; 0 where a piece would be empty."""
        n = math.floor(2 * len(t) * (1 - self.threshold / 100) + 1e-9) + 1
        q = len(t) // n if n > 0 else 0
        return q, [t[i * q : (i + 1) * q] for i in range(n)] if q else []

    def add(self, block: str, text: str) -> None:
        t, at = text.lower(), len(self.texts)
        self.texts.append((t, Counter(t)))
        self.blocks[block].append(at)
        q, pieces = self._cut(t)
        self.sizes[block].add(q)
        for piece in set(pieces) or {""}:
            self.pieces[block, q][piece].append(at)

    def _holding(self, block: str, q: int) -> dict[str, list[int]]:
        """Added texts by the q letters in a row that they hold."""
        done, found = self.grams.get((block, q), (0, defaultdict(list)))
        own = self.blocks[block]
        for at in own[done:]:
            t = self.texts[at][0]
            for g in {t[i : i + q] for i in range(len(t) - q + 1)}:
                found[g].append(at)
        self.grams[block, q] = len(own), found
        return found

    def meets(self, block: str, text: str) -> bool:
        own = self.blocks.get(block)
        if not own:
            return False
        t, seen = text.lower(), set()
        q, pieces = self._cut(t)
        if q:
            by_own = self._holding(block, q)
            seen.update(at for piece in set(pieces) for at in by_own.get(piece, ()))
            for size in self.sizes[block]:
                known = self.pieces[block, size]
                for g in {t[i : i + size] for i in range(len(t) - size + 1)} if size else ("",):
                    seen.update(known.get(g, ()))
        else:
            seen.update(own)
        bag = Counter(t)
        for at in sorted(seen):
            other, letters = self.texts[at]
            short = min(len(t), len(other))
            if (bag & letters).total() * (200 - self.threshold) >= short * self.threshold - 1e-6 and score(t, other, self.threshold) >= self.threshold:
                return True
        return False


def similar_to(c: Column, target: str, threshold: float) -> Column:
    """True where the cell, without outer white space, scores `threshold` or more against the target."""

    @F.pandas_udf(T.BooleanType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, bool] = {}
        for s in batches:
            for v in s.unique():
                if v not in known:
                    known[v] = score(v.strip(), target) >= threshold
            yield s.map(known).astype(bool)
            if len(known) > 100_000:
                known.clear()

    return run(c)
