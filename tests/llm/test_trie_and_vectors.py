"""Operators 11 to 13 against brute-force versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import conversation_trie, hard_negatives, permutation, vector_blocks
from tabweave.llm.common import table

CONV = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [y[2] for y in sorted(v)] for c, v in own.items()}
    start = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: start[c]] + v[start[c] :] for c, v in own.items()}


def nodes(convs):
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), {}, {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = {k: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()), key=str)


def trie(df, **more):
    return sorted(map(tuple, conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.turns(df)), **more).collect()), key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 30])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["x", "x", "x", "", "yy", None]) if t > rng.choice([0, 4, 25]) else "x"))
    return rows


@pytest.mark.parametrize(("seed", "first", "grow"), [(1, 2, 2), (2, 1, 8), (3, 4096, 64)])
def test_trie_equals_brute_force(spark, seed, first, grow):
    rows = random_rows(seed, 40)
    assert trie(spark.createDataFrame(rows, CONV), first=first, grow=grow) == nodes(rebuilt(rows))


def test_trie_of_given_conversations_with_odd_rows(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, 0, "user", "lost"), (3, None, "user", "first"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (900_000, 0, None, None), (900_001, 0, "user", "é" * 200_000), (-7, 0, "user", "below")]
    df = spark.createDataFrame(rows, CONV)
    for name in ("path", "end", "node", "lo", "hi", "at", "sid", "id"):
        df = df.withColumn(name, F.lit("clash"))
    known = [r for r in rows if r[0] is None or r[0] >= 0]
    assert trie(df.where("conv_id is null or conv_id >= 0"), first=50, grow=4) == nodes(rebuilt(known))
    assert len(trie(df)) >= len(nodes(rebuilt(known)))


def test_trie_without_conversations_and_turns(spark):
    assert trie(spark.createDataFrame([], CONV)) == []
    # all turns of conversation 6 are before its h, and it has no conversation 5 to take them from
    c = next(c for c in range(6, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    got = trie(spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], CONV))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_nodes_are_hashed_at_their_handles(spark):
    cases = [(lo, hi) for lo in range(40) for hi in range(lo + 1, 42)]
    df = spark.createDataFrame(cases, "lo int, hi int")
    for lo, hi, f in df.select("lo", "hi", conversation_trie.fattest(F.col("lo"), F.col("hi")).alias("f")).collect():
        assert f == max(range(lo + 1, hi + 1), key=lambda x: x & -x)


def test_many_copies_end_in_one_node(spark):
    rows = [(5 * i, 0, "user", "same") for i in range(3000)]
    got = trie(spark.createDataFrame(rows, CONV), first=10)
    assert [g[3] for g in got] == [3000, 3000] and got == nodes(rebuilt(rows))


def vectors(spark, n=900, dim=12, seed=0, odd=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = (centres[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * 0.4) * rng.uniform(0.2, 3, (n, 1))
    x[7] = x[8] = x[9]
    rows = [(i, [float(np.float32(v)) for v in r], int(rng.integers(0, 4)) if i % 3 else 1) for i, r in enumerate(x)]
    if odd:
        rows += [(9_000, None, 1), (9_100, [None] * dim, 1), (9_200, [float("nan")] * dim, 1), (9_300, [0.0] * dim, 1), (9_400, [1.0, 2.0], 1), (9_401, [1.0, 2.5], 2), (9_402, [2.0, 2.5], 1), (None, rows[0][1], 1), (9_500, rows[3][1], None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("id", "v", "dim", "hash", "asks", "block", "score")}), rows


def kept(rows, zero=True):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and (zero or any(r[1]))]


def negatives(rows, ratio=80):
    own = [(i, l, [int(np.floor(256 * v)) for v in x]) for i, x, l in kept(rows) if l is not None]
    out, asked = [], {}
    for r in sorted(own):
        if r[0] % 100 == 0:
            asked.setdefault((r[0], len(r[2])), r)
    for a, label, q in asked.values():
        s = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, l, v in own if i != a and len(v) == len(q)]
        for p, pid, _ in sorted(x for x in s if x[2] == label)[:5]:
            good = sorted(x for x in s if x[2] != label and ratio * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(a, pid, k + 1, x[1], -p, -x[0]) for k, x in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 8192])
def test_hard_negatives_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 32)
    monkeypatch.setattr(hard_negatives, "LEAST_BUCKET", 8)
    df, rows = vectors(spark)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), block=block)
    assert sorted(map(tuple, got.collect())) == negatives(rows)


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, [float((-1) ** i * 2e4 * (i + 1)), 3e6, float(i)], i % 2) for i in range(0, 500, 25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == negatives([(i, [float(np.float32(v)) for v in x], l) for i, x, l in rows])


def test_coordinates_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(2000, 8)) + 4 * np.eye(8)[rng.integers(0, 8, 2000)])).astype(np.int64)
    b = hard_negatives.Block(hard_negatives.bucketed({"id": np.arange(2000), "label": np.zeros(2000, np.int64), "v": x}))
    q = x[17].astype(np.float64)
    least = float(np.sort(x @ x[17])[-20])
    found = [i for rows, s in b.search(q, x[17], least, lambda low, high: False) for i in rows[s >= least].tolist()]
    assert sorted(found) == np.flatnonzero(x @ x[17] >= least).tolist() and b.looked < 1000


def test_vector_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert permutation.nearest(df, F.col("vec_id") % 100 == 0).count() == 0


def distances(rows, k):
    own, out = kept(rows, zero=False), {}
    for a, q in {(i, len(x)): x for i, x, _ in sorted(own, key=lambda r: (r[0], r[1]), reverse=True) if i % 100 == 0}.items():
        far = sorted((float(np.sqrt(((np.array(x) - np.array(q)) ** 2).sum())), i) for i, x, _ in own if i != a[0] and len(x) == a[1])
        out[a[0]] = far[:k]
    return out


def test_permutation_index_finds_nearly_all(spark, sf_dir):
    df, rows = vectors(spark, 2000, 24)
    given = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    for frame, own, block in ((df, rows, 500), (table(spark, sf_dir, "embeddings"), given, 8192)):
        got, hits, all_ = defaultdict(list), 0, 0
        for q, rank, i, s in permutation.nearest(frame, F.col("vec_id") % 100 == 0, block=block).collect():
            got[q].append((rank, s, i))
        want = distances(own, 10)
        assert got.keys() == {q for q in want if want[q]}
        for q, best in want.items():
            mine = sorted(got[q])
            assert [r for r, *_ in mine] == list(range(1, len(best) + 1)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
            hits, all_ = hits + len({i for _, i in best} & {x[2] for x in mine}), all_ + len({i for _, i in best})
        assert hits / all_ >= 0.9


def test_permutation_index_is_exact_where_all_rows_are_looked_at(spark):
    df, rows = vectors(spark, 300)
    got = defaultdict(list)
    for q, rank, i, s in permutation.nearest(df, F.col("vec_id") % 100 == 0, share=1.0).collect():
        got[q].append((rank, s, i))
    want = {q: [(k + 1, *x) for k, x in enumerate(v)] for q, v in distances(rows, 10).items() if v}
    assert {q: sorted(v) for q, v in got.items()} == {q: [(r, pytest.approx(s, abs=1e-12), i) for r, s, i in v] for q, v in want.items()}


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(5)
    x, pivots = rng.normal(size=(50, 6)), rng.normal(size=(20, 6))
    order, posted = permutation.places(x, pivots, 12), 12
    block = {"id": np.arange(50)} | permutation.inverted(order, 20)
    asked = permutation.places(rng.normal(size=(1, 6)), pivots, 5)[0]
    for r, f in enumerate(permutation.footrule(block, asked, posted).tolist()):
        own = {int(p): i for i, p in enumerate(order[r])}
        assert f == sum(abs(own.get(int(p), posted) - j) for j, p in enumerate(asked))


def test_blocks_hold_every_row_once(spark):
    df, rows = vectors(spark, 500)
    rows = df.where(vector_blocks.whole("embedding")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(0).cast("long").alias("label"), F.size("embedding").alias("dim")).where("id is not null")
    blocks = [(r["dim"], vector_blocks.load(r["payload"])) for r in vector_blocks.packed(rows, ["id"], 70).collect()]
    assert sorted(i for _, b in blocks for i in b["id"].tolist()) == sorted(r["id"] for r in rows.select("id").collect())
    assert all(len(b["id"]) <= 70 and b["v"].shape[1] == d for d, b in blocks)
