import random

from tokenizers import Tokenizer

from tabweave.llm import bpe, pieces, token_counts

TEXTS = ["", "  \n", "Hello World's end", "<|endoftext|> a<|startoftext|>b <|endof", "straße ÉTÉ é İ Σας ﬁ", "中文 한글 🙂 x\x1cy\x1fz a\xa0b", "x" * 50_000, "word " * 20_000, "!!!'s 123 ４５"]


def library():
    return Tokenizer.from_file(pieces.default_tokenizer())


def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(1, "again"), (1, "again"), (None, "no key"), (99, None)]


def test_ids_and_decoded_text_are_the_librarys(make_docs, clashes):
    out = bpe.decode(bpe.encode(make_docs(rows(), clashes))).select("doc_id", "text", "ids", "decoded").collect()
    t = library()
    assert len(out) == len(rows())
    for r in out:
        want = t.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == t.decode(want, skip_special_tokens=False)
    at_once = bpe.encode(make_docs(rows(), clashes), decoded="decoded").select("doc_id", "text", "ids", "decoded").collect()
    assert sorted(map(str, at_once)) == sorted(map(str, out))


def test_random_texts_against_the_library():
    t, e, rnd = library(), pieces.Encoder(pieces.default_tokenizer(), capacity=500), random.Random(3)
    pool = list("abcXYZ'stT019 .,!?-_\t\n\x0b\x1c\x1f\x85\xa0éÉçßÄİſΣσς́ 　中한🙂①²Ⅷ\x00\x7f\xad") + ["'ll", "<|endoftext|>", "ﬁ"]
    for _ in range(60):
        texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(10)]
        ids, at, decoded = e.encode(texts, True)
        for k, x in enumerate(texts):
            want = t.encode(x, add_special_tokens=False).ids
            assert ids[at[k] : at[k + 1]].tolist() == want and decoded[k] == t.decode(want, skip_special_tokens=False)


def test_every_cut_is_forced():
    v = pieces.vocabulary(pieces.default_tokenizer())
    cut = next(a + b for a in "éßç" for b in "zq" if len(v.fragments("".join(pieces._LETTERS[x] for x in (a + b).encode()))) > 1)
    assert v.library.encode(cut, add_special_tokens=False).ids == v.ids("".join(pieces._LETTERS[x] for x in cut.encode()))


def test_null_ids_decode_to_an_empty_text(spark):
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["decoded"] == ""


def test_counts_are_the_librarys(make_docs, clashes):
    for hot in (1, 1000):
        out = token_counts.token_counts(make_docs(rows(), clashes), hot=hot, limit=100)
        t = library()
        want = sorted(((i if i is not None else -1), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for i, x in rows())
        got = sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
        assert got == want


def test_empty_tables(make_docs):
    assert bpe.decode(bpe.encode(make_docs([]))).count() == 0
    assert token_counts.token_counts(make_docs([])).count() == 0


def test_digests(make_docs):
    import hashlib

    r = bpe.digests(bpe.encode(make_docs([(1, "a b")]), decoded="decoded")).first()
    ids = library().encode("a b", add_special_tokens=False).ids
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_a_worker_keeps_little_of_reading_the_vocabulary():
    import subprocess
    import sys

    code = """
import re
from tabweave.llm import pieces
from tabweave.llm.common import give_back
anon = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
give_back()
before, e = anon(), pieces.encoder(pieces.default_tokenizer()).words
e.inner_lines, e.end_lines, e.joined
print(anon() - before)
"""
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 48
