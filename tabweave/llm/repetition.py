"""Operator 8: quality rules on repeated substrings, found with a suffix array.

The suffixes of all documents of a batch are sorted by prefix doubling over words;
a document's number is part of its first ranks, so suffixes meet only their own
document's. Common prefixes of neighbours come from the ranks of each doubling. The
larger of the two at a word is the longest repeat that starts there, so the union of
those spans is the union of the spans of all maximal repeated substrings.

Rules: repeats of `least` words or more cover at most `covered` of the characters,
and no repeat is longer than `longest` words. The base rules are those of the
contract: 50 words at least, and at most half of them in three-word windows that
the text holds twice.

Defined results: null text counts as empty and fails the base rules; rows stay apart
even where keys repeat; whole texts, of any length; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_null, slices, text_batches

#: Fixed value: the characters that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
_BLANK = (9, 10, 11, 12, 13, 32)
LEAST, COVERED, LONGEST = 8, 0.4, 60


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length in words of the longest string from there that its document holds elsewhere too."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    stop = np.searchsorted(doc, doc, side="right")  # end of the word's document
    levels, step = [rank.copy()], 1
    alone = np.bincount(rank, minlength=n)
    active = np.flatnonzero(alone[rank] > 1)
    while len(active):
        ahead = active + step
        second = np.where(ahead < stop[active], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        at, old, new = active[by], rank[active[by]], second[by]
        old_head = np.concatenate([[True], old[1:] != old[:-1]])
        new_head = old_head | np.concatenate([[True], new[1:] != new[:-1]])
        here = np.arange(len(at))
        ranked = old + np.maximum.accumulate(np.where(new_head, here, 0)) - np.maximum.accumulate(np.where(old_head, here, 0))
        rank[at] = ranked
        levels.append(rank.copy())
        step *= 2
        single = np.concatenate([new_head[1:], [True]]) & new_head
        active = np.sort(at[~single])
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        p, q = a[live] + common[live], b[live] + common[live]
        fits = (p < stop[a[live]]) & (q < stop[b[live]])
        same = fits & (levels[k][np.minimum(p, n - 1)] == levels[k][np.minimum(q, n - 1)])
        common[live[same]] += 1 << k
    best = np.zeros(n, np.int64)
    best[a] = common
    best[b] = np.maximum(best[b], common)
    return best


def _covered(best: np.ndarray, least: int, span: np.ndarray | int) -> np.ndarray:
    """Which words the spans from words whose repeat has `least` words cover."""
    edge, at = np.zeros(len(best) + 1, np.int64), np.flatnonzero(best >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (span if isinstance(span, int) else span[at]), -1)
    return np.cumsum(edge[:-1]) > 0


def _figures(texts: list[str], least: int) -> dict[str, np.ndarray]:
    ids: defaultdict = defaultdict(count().__next__)
    words, sizes, sums, n_words, symbols, lines = [], [], [], [], [], []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        w = raw.split()
        words.append(np.fromiter(map(ids.__getitem__, w), np.int64, len(w)))
        each = np.fromiter(map(len, w if len(raw) == len(t) else [x.decode("utf-8", "surrogatepass") for x in w]), np.int64, len(w))
        by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        sizes.append(each)
        n_words.append(len(w))
        sums.append(len(t) - int(by_byte[list(_BLANK)].sum()))
        symbols.append(int(by_byte[list(SYMBOLS)].sum()))
        full = [x for x in raw.split(b"\n") if x.split()]
        lines.append(len(full) - len(set(full)))
    docs = np.repeat(np.arange(len(texts)), n_words)
    best = longest_repeats(np.concatenate(words), docs) if texts else np.zeros(0, np.int64)
    size = np.concatenate(sizes) if texts else best
    add = lambda x: np.bincount(docs, x, len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, docs, best)
    return {
        "n_words": np.array(n_words, np.int64),
        "word_chars": np.array(sums, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": add(_covered(best, 3, 3)),
        "covered_fraction": add(size * _covered(best, least, best)) / np.maximum(add(size), 1),
        "longest_repeat": longest,
    }


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """key, base figures, covered_fraction, longest_repeat, base_failed and kept of every row."""
    df = text_batches(docs).select(F.col(key).alias("key"), blank_null(text).alias("text"))
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = _figures(batch.column(batch.schema.get_field_index("text")).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), *map(pa.array, found.values())], names=["key", *found])

    out = df.mapInArrow(run, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_fraction double, longest_repeat long")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    good = ~F.col("base_failed") & (F.col("covered_fraction") <= covered) & (F.col("longest_repeat") <= longest)
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", good.alias("kept"), "covered_fraction", "longest_repeat")
