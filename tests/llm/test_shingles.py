import random

from tabweave.llm import shingles


def test_word_hashes_are_one_to_one_and_keep_no_words():
    r = random.Random(1)
    parts = ["a", "B", "é", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "xyz", "Q" * 70, "w" * 64, "w" * 65, "\ud800"]
    for at_once in (1, 7, 1 << 18):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(200)]
        hashes, sizes = shingles.word_hashes(texts, at_once)
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        assert sizes.tolist() == [len(x) for x in split]
        known = {}
        assert all(known.setdefault(w, h) == h for w, h in zip((w for x in split for w in x), hashes.tolist(), strict=True))
        assert len(set(known.values())) == len(known)
    assert not hasattr(shingles, "_words")
