"""Word shingles of texts as 64-bit hashes, worked out for a batch of texts at once."""

from __future__ import annotations

import numpy as np

#: Multipliers of a 64-bit mixing function.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((_BASE * (salt + 1)) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


#: Bytes that are white space, and a number for each byte at each of 64 places of a word.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_AT = 64
_BYTES = mix(np.arange(_AT * 256), 3)


def _hashed(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of some bytes (the numbers of its bytes at their places, summed up), and where it starts."""
    inside = ~_SPACE[text]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    value = _BYTES[(place & (_AT - 1)) * 256 + text[inside]]
    if sizes.max() > _AT:
        far = np.flatnonzero(place >= _AT)
        value[far] *= mix(place[far] // _AT, 4) | np.uint64(1)
    return mix(np.add.reduceat(value, first), 5), starts


def word_hashes(texts: list[str], at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and each text's number of words."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
    whole = b"\n".join(coded).lower()
    text, out, found, at = np.frombuffer(whole, np.uint8), [], [], 0
    while at < len(text):
        end = at + at_once
        while end < len(text) and not _SPACE[text[end]]:  # no word is cut
            end += 1
        h, starts = _hashed(text[at:end])
        out.append(h)
        found.append(starts + at)
        at = end
    starts = np.concatenate(found) if found else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.diff(np.searchsorted(starts, begin))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    n = max(len(words) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(_BASE) + words[i : i + n]
    return mix(h, k)


def sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Each text's distinct k-word shingles in order of hash; fewer words: the whole text as one; none: empty."""
    words, sizes = word_hashes(texts)
    all_windows, at, out = windows(words, k), 0, []
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(all_windows[at : at + n - k + 1]))
        else:
            out.append(windows(words[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out
