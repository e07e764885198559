"""Splitting of texts for a BPE vocabulary whose pre-tokens never span white space.

A text is the sequence of its white-space-separated chunks, and pre-tokens, hence
token ids, depend on one chunk alone: the normaliser (composition, white-space
folding, lower-casing), the split pattern and special strings all work inside a
chunk. So what a distinct chunk gives is worked out once per worker and looked up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache
from operator import add

import numpy as np
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import give_back

#: Python also splits at these four; the vocabulary's pattern does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Fixed value: white space as the vocabulary's pattern has it.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Fixed value: the vocabulary's split pattern, for printable ASCII in lower case.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The same for letters below U+0250, whose classes no Unicode version has changed.
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LATIN_LINES = regex.compile("\n|" + _LATIN.pattern)
_BEYOND_LATIN = re.compile("[\u0000-\u001f\u007f-\u00a0\u0250-\U0010ffff]")
WORD_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it prints in Latin-1, else as the next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _by_line(model: models.Model) -> Tokenizer:
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    return out


def chunks_of(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


class Vocabulary:
    """Pre-tokens of a chunk, pieces of a pre-token and the cuts that no merge can span."""

    def __init__(self, path: str):
        self.path, spec = path, _spec(path)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.special_start = tuple({x[0] for x in self.specials})
        pieces = spec["model"]["vocab"] | self.specials
        self.strings = [""] * (max(pieces.values()) + 1)
        for t, i in pieces.items():
            self.strings[i] = t
        self.spaced = [f" {t}" for t in self.strings]
        del spec, pieces
        give_back()

    @cached_property
    def library(self) -> Tokenizer:
        made = Tokenizer.from_file(self.path)
        give_back()  # reading takes several times what the tokenizer holds
        return made

    @cached_property
    def ends(self) -> models.Model:
        return self.library.model

    @cached_property
    def inner(self) -> models.Model:
        """For inner fragments of a pre-token, none of whose symbols carries the word end."""
        spec = _spec(self.path)
        spec["model"]["end_of_word_suffix"] = None
        coded = json.dumps(spec)
        del spec
        give_back()
        made = Tokenizer.from_str(coded).model
        give_back()
        return made

    @cached_property
    def joined(self) -> set[str]:
        """Pairs of bytes that stand together inside some vocabulary token."""
        bare = [t.removesuffix(WORD_END) for t in self.strings if t not in self.specials]
        return {t[i : i + 2] for t in bare for i in range(len(t) - 1)}

    @cached_property
    def end_lines(self) -> Tokenizer:
        return _by_line(self.ends)

    @cached_property
    def inner_lines(self) -> Tokenizer:
        return _by_line(self.inner)

    def pretokens(self, chunk: str) -> list[str | int]:
        """Pre-tokens in the vocabulary's byte letters; a special string is its id."""
        if any(c in chunk for c in self.special_start):
            parts = self.special_cut.split(chunk)
            if len(parts) > 1:
                return [y for x in parts if x for y in ([self.specials[x]] if x in self.specials else self._plain(x))]
        return self._plain(chunk)

    def _plain(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():
            return _ASCII.findall(chunk.lower())
        if not _BEYOND_LATIN.search(chunk):
            found = _LATIN.findall(unicodedata.normalize("NFC", chunk).lower())
            return [x if x.isascii() else x.encode().decode("latin-1").translate(_LETTERS) for x in found]
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def fragments(self, pretoken: str) -> list[str]:
        """Cut wherever two bytes stand that stand together inside no vocabulary token."""
        joined = self.joined
        if joined.issuperset(map(add, pretoken, pretoken[1:])):
            return [pretoken]
        cuts = [i for i in range(1, len(pretoken)) if pretoken[i - 1 : i + 1] not in joined]
        return [pretoken[a:b] for a, b in zip([0, *cuts], [*cuts, len(pretoken)], strict=True)]

    def ids(self, pretoken: str) -> list[int]:
        """Fragments encoded one by one and put together again."""
        parts = self.fragments(pretoken)
        if len(parts) == 1:
            return [t.id for t in self.ends.tokenize(pretoken)]
        return [t.id for x in parts[:-1] for t in self.inner.tokenize(x)] + [t.id for t in self.ends.tokenize(parts[-1])]

    def n_pieces(self, pretoken: str) -> int:
        return len(self.ends.tokenize(pretoken))

    def encode_many(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pre-tokens in a row, and how many each has: fragments encoded one by one and put together again."""
        parts, owner, last = [], [], []
        for i, p in enumerate(pretokens):
            found = self.fragments(p)
            parts += found
            owner += [i] * len(found)
            last += [False] * (len(found) - 1) + [True]
        ends, sizes = np.array(last, bool), np.zeros(len(parts), np.int64)
        own = np.array(owner, np.int64)
        done = []
        for lines, which in ((self.end_lines, ends), (self.inner_lines, ~ends)):
            ids, n = _each(lines, [parts[i] for i in np.flatnonzero(which)])
            sizes[which] = n
            done.append(ids)
        start = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        for ids, which in zip(done, (ends, ~ends), strict=True):
            n = sizes[which]
            flat[np.repeat(start[which], n) + np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)] = ids
        return flat, np.bincount(own, sizes, len(pretokens)).astype(np.int64)

    def pretokens_many(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of chunks that hold Latin letters and signs only, and how many each chunk has."""
        found = _LATIN_LINES.findall(unicodedata.normalize("NFC", "\n".join(chunks)).lower())
        stops = np.flatnonzero(np.fromiter((x == "\n" for x in found), bool, len(found)))
        n = np.diff(np.concatenate([[-1], stops, [len(found)]])) - 1
        return [x if x.isascii() else x.encode().decode("latin-1").translate(_LETTERS) for x in found if x != "\n"], n

    def simple(self, chunk: str) -> bool:
        return not _BEYOND_LATIN.search(chunk) and not any(c in chunk for c in self.special_start)


def _each(lines: Tokenizer, parts: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """ids of the parts in a row, and how many each has; the library sees many parts at once, a line each."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(parts), at_once):
        some = parts[i : i + at_once]
        e = lines.encode("\n".join(some), add_special_tokens=False)
        ids.append(np.array(e.ids, np.int32))
        sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
    return np.concatenate(ids), np.concatenate(sizes)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Known(dict):
    """chunk -> number of its entry in flat arrays of ids, and in the list of what they decode to (a space before each token)."""

    def __init__(self, words: Vocabulary):
        self.words, self.flat, self.start, self.decoded = words, array("i"), array("q", [0]), []

    def learn(self, chunks: list[str]) -> None:
        """Enters chunks that aren't known yet."""
        words, simple = self.words, []
        for c in chunks:
            if words.simple(c):
                simple.append(c)
            else:
                for p in words.pretokens(c):
                    self.flat.extend([p] if p.__class__ is int else words.ids(p))
                self.decoded.append("".join([words.spaced[i] for i in self.flat[self.start[-1] :]]))
                self.start.append(len(self.flat))
                self[c] = len(self)
        if not simple:
            return
        found, n = words.pretokens_many(simple)
        number: dict[str, int] = {}
        at = np.array([number.setdefault(p, len(number)) for p in found], np.int64)
        flat, sizes = words.encode_many(list(number))
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        starts = (np.cumsum(sizes) - sizes)[at]
        ids = flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        bounds = np.concatenate([[0], ends])[np.cumsum(n)] + len(self.flat)
        strings, cuts = [words.spaced[i] for i in ids.tolist()], (bounds - len(self.flat)).tolist()
        self.decoded += ["".join(strings[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        self.start.frombytes(bounds.astype(np.int64).tobytes())
        self.update(zip(simple, range(len(self), len(self) + len(simple)), strict=True))


class Encoder:
    """Encodes batches of texts; holds at most about `capacity` distinct chunks between batches."""

    def __init__(self, path: str, capacity: int = 250_000):
        self.words, self.capacity = vocabulary(path), capacity
        self.known = _Known(self.words)
        self.hits = np.zeros(0, np.int64)

    def encode(self, texts: list[str], decoded: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """ids of all texts in a row, where each text's ids start, and the decoded texts if asked for."""
        split, found, sizes = [chunks_of(t) for t in texts], [], []
        self.known.learn(list({c for chunks in split for c in chunks}.difference(self.known)))
        known = self.known.__getitem__
        for chunks in split:
            found.append(np.fromiter(map(known, chunks), dtype=np.int64, count=len(chunks)))
            sizes.append(len(chunks))
        del split
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        start = np.frombuffer(self.known.start, dtype=np.int64)
        flat = np.frombuffer(self.known.flat, dtype=np.int32) if len(self.known.flat) else np.zeros(0, np.int32)
        lengths = start[at + 1] - start[at]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(start[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[bounds]
        strings = []
        if decoded:
            each = np.array(self.known.decoded, object)[at]
            strings = ["".join(each[a:b].tolist())[1:] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        hits = np.bincount(at, minlength=len(self.known))
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        if len(self.known) > self.capacity:
            self._forget(start, flat, self.capacity // 2)
        return ids, offsets, strings

    def shrink(self, most: int = 50_000) -> None:
        """Keeps few chunks, some 20 MB: for a worker that lives on for other work."""
        if len(self.known) > most:
            self._forget(np.frombuffer(self.known.start, dtype=np.int64).copy(), np.frombuffer(self.known.flat, dtype=np.int32).copy(), most)

    def _forget(self, start: np.ndarray, flat: np.ndarray, most: int) -> None:
        """Keeps the chunks used most often, `most` of them and no more where many are used alike."""
        old, often = self.known, np.zeros(len(self.hits), bool)
        often[np.argpartition(self.hits, -most)[-most:]] = True
        often &= self.hits >= 2
        chunks = [c for c, k in old.items() if often[k]]
        at = np.array([old[c] for c in chunks], np.int64)
        lengths = start[at + 1] - start[at]
        ends = np.cumsum(lengths)
        self.known = _Known(self.words)
        self.known.flat.frombytes(flat[np.repeat(start[at] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))].astype(np.int32).tobytes())
        self.known.start.frombytes(ends.astype(np.int64).tobytes())
        self.known.decoded = [old.decoded[i] for i in at.tolist()]
        self.known.update(zip(chunks, range(len(chunks)), strict=True))
        self.hits = self.hits[at] // 2


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)
