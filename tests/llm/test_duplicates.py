import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabweave.llm import graph, jaccard_join, passages, shingles


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def brute(rows):
    """Smallest id that links reach, from all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                up[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def corpus():
    r, rows = random.Random(7), []
    line = words(60, 999)
    for g in range(12):
        base = words(r.choice([5, 8, 30, 120, 400]), g)
        for _ in range(r.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
            rows.append(w)
    rows += [line + words(40, 5000 + i) for i in range(25)]  # one passage in many texts
    rows += [["a", "b"], ["A", "B"], ["a"], []]
    out = [(i * 3 + 1, " ".join(w)) for i, w in enumerate(rows)]
    r.shuffle(out)
    return out


def test_components_are_those_of_all_pairs(make_docs, clashes, monkeypatch):
    rows = corpus()
    want = brute(rows)
    for local, tile, steps, broadcast in ((64, 1024, jaccard_join.STEPS, 10**6), (2, 4, ((True, 2), (False, 1)), 0), (3, 5, ((False, 1),), 10**6)):
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", broadcast)
        monkeypatch.setattr(graph, "ONE_TASK", broadcast)
        monkeypatch.setattr(jaccard_join, "LOCAL", local)
        monkeypatch.setattr(jaccard_join, "TILE", tile)
        monkeypatch.setattr(jaccard_join, "STEPS", steps)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(make_docs(rows, [c for c in clashes if c != "component_id"])).collect()}
        assert got == want


def test_nulls_ties_and_empty_tables(make_docs, clashes):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, "A B C D E F"), (6, "x " * 30000)]
    out = sorted(((r[0] or 0), r[1], r[2] or 0) for r in jaccard_join.join(make_docs(rows)).collect())
    assert out == [(0, 2, 0), (1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (5, 2, 3), (6, 1, 6)]
    assert jaccard_join.join(make_docs([])).count() == 0
    for extra in ([], clashes):
        docs = make_docs(rows, extra)
        kept = jaccard_join.deduplicated(docs)
        assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 6] and kept.columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 70), st.integers(0, 10**6))
def test_sets_that_link_share_a_key_and_pass_the_sketch_test(n, changed, seed):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, n + 80).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[min(changed, len(a) - 1) :], r.integers(0, 2**63, changed // 2).astype(np.uint64)]))
    a = a[: len(a) - 0]
    common = len(np.intersect1d(a, b))
    if 100 * common >= 80 * (len(a) + len(b) - common):
        assert np.intersect1d(jaccard_join.keys_of(a), jaccard_join.keys_of(b)).size
        assert jaccard_join.can_link(len(a), jaccard_join.bit_sketch(a), len(b), jaccard_join.bit_sketch(b))


def test_shingles_of_short_texts():
    s = shingles.sets(["", "a", "A", "a b", "a b c d e", "a b c d e f"])
    assert [len(x) for x in s] == [0, 1, 1, 1, 1, 2] and s[1][0] == s[2][0] and s[1][0] != s[3][0]


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_connected_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(90)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            u, v = find(a), find(b)
            up[max(u, v)] = min(u, v)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_edit_distance(a, b):
    assert passages.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64)) == levenshtein(a, b)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=2, max_size=25))
def test_best_chain_is_the_best_of_all(matches):
    """The Fenwick tree's first chain scores as the quadratic recursion's best."""
    m = sorted(set(matches))
    best = []
    for i, (p, q) in enumerate(m):
        best.append(1 + max([0.0] + [best[j] - passages.GAP * ((p - m[j][0]) + (q - m[j][1])) for j in range(i) if m[j][0] < p and m[j][1] < q]))
    found = passages.chains(m)
    if found:
        a, b, c, d = found[0]
        ends = [x for x, y in zip(m, best, strict=True) if abs(y - max(best)) < 1e-9]
        assert (b - passages.K, d - passages.K) in ends or b - a < passages.SPAN or max(best) > 0


def text(*parts):
    return " ".join(w for p in parts for w in p)


def test_passages_over_fifty_words(make_docs, clashes):
    p, fuzzy = words(60, 1), words(80, 2)
    edited = list(fuzzy)
    for k in (10, 31, 55):
        edited[k] = "changed"
    del edited[40]
    rows = [(1, text(words(100, 10), p)), (2, text(p, words(90, 11))), (3, text(words(30, 12), p, words(30, 13))), (4, text(fuzzy)), (5, text(words(20, 14), edited, words(5, 15))), (6, text(words(200, 16))), (7, text(p[:40], words(60, 17))), (8, None), (None, text(p)), (9, "and " * 70), (10, "and " * 90)]
    found = passages.repeated(make_docs(rows, clashes)).collect()
    by = {(r["doc_id"], r["source"]): r for r in found}
    assert set(by) == {(2, 1), (3, 1), (5, 4), (10, 9)}
    t3 = dict(rows)[3]
    assert t3[by[3, 1]["start"] : by[3, 1]["end"]] == " ".join(p) and by[5, 4]["identity"] > 0.9
    left = {r["doc_id"]: r["text"] for r in passages.removed(make_docs(rows, clashes)).collect() if r["doc_id"] is not None}
    assert left[1] == dict(rows)[1] and " ".join(p) not in left[3] and left[3].startswith(text(words(30, 12))) and left[8] is None and left[7] == dict(rows)[7]
    assert passages.removed(make_docs(rows, clashes)).columns == make_docs(rows, clashes).columns


def test_no_passages_in_empty_tables(make_docs):
    assert passages.repeated(make_docs([])).count() == 0 and passages.removed(make_docs([])).count() == 0


def test_rows_of_one_key(make_docs, clashes):
    t, other, alone = text(words(80, 3)), text(words(100, 4)), text(words(70, 5))
    assert passages.repeated(make_docs([(1, t), (1, t)])).count() == 0
    # texts that share a key keep their own spans; a null beside a text hides nothing
    rows = [(1, text(words(60, 6), words(40, 7))), (5, text(words(20, 8), words(60, 6))), (5, other), (5, None), (7, alone), (7, None), (7, text(words(60, 6))), (7, text(words(60, 6))), (9, alone), (9, "")]
    docs = make_docs(rows, clashes)
    found = sorted((r["doc_id"], r["source"], r["n_words"]) for r in passages.repeated(docs).collect())
    assert found == [(5, 1, 60), (7, 1, 60), (9, 7, 70)]
    left = sorted((r["doc_id"], (r["text"] or "").strip()) for r in passages.removed(docs).collect())
    assert left == sorted([(1, rows[0][1]), (5, text(words(20, 8))), (5, other), (5, ""), (7, alone), (7, ""), (7, ""), (7, ""), (9, ""), (9, "")])


def quoted(seed):
    """Texts with exact and changed copies, among many that share short runs of the same passages."""
    r, rows = random.Random(seed), []
    sources = [words(r.randint(60, 140), 1000 * seed + g) for g in range(6)]
    for p in sources:
        for _ in range(r.choice([3, 14, 40])):  # short runs, none a repeat itself
            a = r.randrange(len(p) - 24)
            rows.append(words(r.randint(5, 40), r.random()) + p[a : a + r.randint(6, 24)] + words(r.randint(5, 40), r.random()))
        for _ in range(r.choice([2, 3, 12])):
            q, rate = list(p), r.choice([0, 0, 0.03, 0.08])
            for k in range(len(q)):
                if r.random() < rate:
                    q[k] = f"x{r.random()}"
            rows.append(words(r.randint(0, 80), r.random()) + q + words(r.randint(0, 80), r.random()))
    r.shuffle(rows)
    return [(10 * i, " ".join(w)) for i, w in enumerate(rows)]


def repeats(rows):
    """Of all pairs of texts: words of the later one in passages of 50 or more words that the earlier one has, 80 % alike."""
    out = {}
    split = {i: np.array([hash(w) for w in t.split()], np.int64) for i, t in rows}
    for j in split:
        covered = np.zeros(len(split[j]), bool)
        for i in split:
            if i < j and len(set(split[i].tolist()) & set(split[j].tolist())) > 30:
                step = passages.steps(split[j], split[i])
                at, equal = np.concatenate([[0], np.cumsum(step[:, 0])]), step[:, 2]
                for lo in range(len(step)):
                    if equal[lo]:
                        size = at[lo + 1 :] - at[lo]
                        alike = np.cumsum(equal[lo:]) / np.arange(1, len(step) - lo + 1)
                        good = np.flatnonzero((size >= 50) & (alike >= 0.8) & (equal[lo:] == 1))
                        if len(good):
                            covered[at[lo] : at[lo + 1 + good[-1]]] = True
        out[j] = covered
    return out


def test_repeats_of_all_pairs_for_any_number_of_partitions(make_docs, monkeypatch):
    for seed, local, partitions in ((1, 64, (1, 4, 16)), (3, 3, (1, 5))):
        monkeypatch.setattr(passages, "LOCAL", local)
        rows, results = quoted(seed), []
        for n in partitions:
            results.append(sorted(map(tuple, passages.repeated(make_docs(rows).repartition(n)).collect()), key=str))
        assert all(x == results[0] for x in results)
        want, got = repeats(rows), {}
        for i, t in rows:
            starts = np.cumsum([0] + [len(w) + 1 for w in t.split()])[:-1]
            mine = [x for x in results[0] if x[0] == i]
            got[i] = np.array([any(x[1] <= s < x[2] for x in mine) for s in starts.tolist()], bool)
        hit, total = sum((want[i] & got[i]).sum() for i in got), sum(want[i].sum() for i in got)
        wrong = sum((got[i] & ~want[i]).sum() for i in got)
        assert total > 1000 and hit >= 0.9 * total and wrong <= 0.02 * total, (hit, total, wrong)


def test_one_passage_of_two_texts_among_many_short_runs_of_it(make_docs):
    r, p = random.Random(11), words(60, 11)
    rows = [(i, text(words(20, 900 + i), p[(a := r.randrange(36)) : a + 24], words(20, 9000 + i))) for i in range(60)]
    rows += [(100, text(words(30, 1), p)), (200, text(p, words(30, 2)))]
    for n in (1, 16):
        assert {(x["doc_id"], x["source"]) for x in passages.repeated(make_docs(rows).repartition(n)).collect()} == {(200, 100)}


def test_joins_without_broadcast_give_the_same(make_docs, monkeypatch):
    rows = quoted(4)
    want = sorted(map(str, passages.repeated(make_docs(rows)).collect()))
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 0)
    assert sorted(map(str, passages.repeated(make_docs(rows)).collect())) == want


def test_passages_of_a_chain_with_unlike_words_between(make_docs):
    one, long = words(60, 1), words(120, 3)
    rows, expected = [], {}
    for g, gap in enumerate((50, 100, 200, 400)):
        a, b = [[f"{side}{g}_{i}" for i in range(gap)] for side in "xy"]
        tag = [f"t{g}_{i}" for i in range(60)]
        rows += [(10 * g, " ".join([*one[: 30 - g], *tag, *a, *tag[::-1]])), (10 * g + 1, " ".join([*tag, *b, *tag[::-1]]))]
        expected[10 * g + 1] = " ".join(b)
    rows += [(90, " ".join(long)), (91, " ".join([*long[:60], *(f"z{i}" for i in range(40)), *long[60:]]))]
    left = {r["doc_id"]: r["text"].strip() for r in passages.removed(make_docs(rows)).collect()}
    assert {k: left[k] for k in expected} == expected
    assert left[91] == " ".join(f"z{i}" for i in range(40)) and left[90] == " ".join(long)


@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=40))
def test_steps_are_a_shortest_edit(a, b):
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    for limit in (passages.STEPS, 1):
        old, passages.STEPS = passages.STEPS, limit
        try:
            s = passages.steps(a, b)
        finally:
            passages.STEPS = old
        assert s[:, 0].sum() == len(a) and s[:, 1].sum() == len(b) and (1 - s[:, 2]).sum() == passages.edit_distance(a, b)
        at, bt = np.cumsum(s[:, 0]) - 1, np.cumsum(s[:, 1]) - 1
        assert all(a[at[i]] == b[bt[i]] for i in np.flatnonzero(s[:, 2]))


def test_exact_copy_of_a_passage_whose_halves_have_earlier_holders(make_docs):
    p, before = words(60, 70), words(40, 71)
    # windows of the passage scatter over earlier texts, none with 50 words of it
    rows = [(i, text(words(30, 80 + i), p[i : i + 12], words(30, 180 + i))) for i in range(49)]
    rows += [(100, text(words(30, 72), p[:30])), (101, text(p[30:], words(30, 73))), (102, text(p, words(50, 74))), (103, text(before, p, words(35, 75)))]
    found = {(r["doc_id"], r["source"]): r["n_words"] for r in passages.repeated(make_docs(rows)).collect()}
    assert found[103, 102] >= 60 and {k[0] for k in found} == {103}


def test_both_copies_in_one_text(make_docs):
    p = words(60, 76)
    rows = [(1, text(p, words(40, 77))), (2, text(p[20:40], words(30, 78), p, words(30, 79), p, words(10, 80)))]
    left = {r["doc_id"]: r["text"] for r in passages.removed(make_docs(rows)).collect()}
    assert " ".join(p[45:]) not in left[2] and " ".join(p[:15]) not in left[2] and left[1] == rows[0][1]


def test_recall_of_changed_copies():
    r = random.Random(5)
    fresh = lambda n: [f"f{r.getrandbits(60)}" for _ in range(n)]
    for alike, least_found in ((0.95, 0.99), (0.9, 0.97), (0.85, 0.95), (0.8, 0.9)):
        found = 0
        for _ in range(100):
            p = fresh(50)
            q = list(p)
            # the ends stay, so that all 50 words are the passage
            for k in r.sample(range(1, 49), round(50 * (1 - alike))):
                q[k] = fresh(1)[0]
            a, b = text(fresh(50), p, fresh(50)), text(fresh(70), q, fresh(40))
            keys, which, places = passages.seeds([a, b])
            first = dict(zip(keys[which == 0].tolist()[::-1], places[which == 0].tolist()[::-1], strict=True))
            met = np.array([(y, first[k]) for k, y in zip(keys[which == 1].tolist(), places[which == 1].tolist(), strict=True) if k in first]).reshape(-1, 2)
            wa, wb = (shingles.word_hashes([t])[0] for t in (a, b))
            found += any(passages.passages(wb, s, e, wa, os, oe) for s, e, os, oe in passages.chains(passages.thinned(met[:, 0], met[:, 1])))
        assert found >= 100 * least_found, (alike, found)


def test_changed_copies_among_many_quotations(make_docs, monkeypatch):
    for alike, q, least_found, limit in ((0.95, 40, 18, passages.ROUND), (0.85, 12, 18, passages.ROUND), (0.85, 40, 18, 2000), (0.8, 40, 17, passages.ROUND)):
        monkeypatch.setattr(passages, "ROUND", limit)
        r, rows = random.Random(7), []
        for g in range(20):
            p = words(60, 500 + g)
            for _ in range(q):
                a = r.randrange(len(p) - 24)
                rows.append((len(rows), text(words(20, r.random()), p[a : a + 24], words(20, r.random()))))
            changed = list(p)
            for k in r.sample(range(1, 59), round(60 * (1 - alike))):
                changed[k] = f"x{r.random()}"
            rows += [(100_000 + g, text(words(30, r.random()), p, words(10, r.random()))), (200_000 + g, text(words(10, r.random()), changed, words(30, r.random())))]
        results = [sorted(map(tuple, passages.repeated(make_docs(rows).repartition(n)).collect()), key=str) for n in ((1, 16) if q == 12 else (4,))]
        assert all(x == results[0] for x in results)
        assert {x[0] for x in results[0]} <= set(range(200_000, 200_020))
        assert len({x[0] for x in results[0] if x[4] == x[0] - 100_000}) >= least_found, (alike, q, results[0])


def test_a_text_that_repeats_itself_seeks_as_one_stretch():
    import pyarrow as pa

    spots = passages.pack_small(np.arange(1990) * 4 + 2)
    batch = pa.RecordBatch.from_pylist([{"id": 5, "text": "and " * 2000, "spots": spots, "spans": None}])
    (out,) = passages._twos(50, True)(iter([batch]))
    assert [(r["p"], r["q"]) for r in out.to_pylist()] == [(0, 1989)]


def test_a_word_again_and_again_is_cut_whole(make_docs):
    # the earlier text has it fewer times than the later ones, but often enough for a passage
    rows = [(1, text(words(30, 1), ["la"] * 60, words(30, 2))), (2, text(words(20, 3), ["la"] * 400, words(20, 4))), (3, text(["la"] * 30, words(30, 5), ["la"] * 75, words(10, 6)))]
    rows += [(10 + i, text(words(20, 10 + i), ["de"] * (20 + i), words(20, 50 + i))) for i in range(20)]
    rows += [(40, text(words(20, 7), ["de"] * 55)), (41, text(["de"] * 300, words(20, 8)))]
    left = {r["doc_id"]: r["text"].split() for r in passages.removed(make_docs(rows)).collect()}
    assert left[1].count("la") == 60 and left[2].count("la") == 0 and left[3].count("la") == 30
    assert left[40].count("de") == 55 and left[41].count("de") == 0 and all(left[10 + i].count("de") == 20 + i for i in range(20))


def test_few_rows_of_many_bytes_are_not_broadcast(spark):
    rows = spark.range(40).selectExpr("id", "cast(repeat('x', 1000000) as binary) as chains")
    spans = spark.range(4).selectExpr("id", "transform(sequence(1, 500000), x -> struct(x as word, x as n_words)) as spans")
    assert passages._beside(rows) is rows and passages._beside(spans) is spans
    assert passages._beside(rows.select("id")) is not rows and "broadcast" in passages._beside(rows.select("id"))._jdf.queryExecution().logical().toString()


def test_passages_are_the_same_if_nothing_is_broadcast(make_docs, monkeypatch):
    rows = [(i, text(words(20, i), words(40, 500), words(10 + i, 501), words(15, 100 + i))) for i in range(30)]
    want = sorted(map(str, passages.repeated(make_docs(rows)).collect()))
    monkeypatch.setattr(passages, "BROADCAST_BYTES", 0)
    assert want and sorted(map(str, passages.repeated(make_docs(rows)).collect())) == want
    # cut from the texts, as in the pipeline
    cut = passages.removed(make_docs(rows))
    assert "ResolvedHint" not in cut._jdf.queryExecution().analyzed().toString()
    assert sum("w" in r["text"] and len(r["text"].split()) < 40 for r in cut.collect()) == 29


def stretches():
    """Texts' word hashes round one phrase, some of them alike beyond it."""
    r, base = random.Random(3), words(90, 77)
    out = []
    for i in range(60):
        w = words(90, 1000 + i)
        w[40:54] = base[40:54]
        if i % 3 == 0:
            for k in range(90):
                if r.random() < 0.85:
                    w[k] = base[k]
        out.append(shingles.word_hashes([text(w)])[0])
    return out


def test_texts_that_may_be_alike_meet_and_those_that_share_a_phrase_do_not():
    import pyarrow as pa

    rows = []
    for i, w in enumerate(stretches()):
        spare, bits = passages.sketches(w, np.array([40]), np.array([54]))
        rows += [{"key": 9, "id": i, "seeks": s, "spare": int(spare[0]), "sketch": bits[0].tobytes()} for s in (True, False)]
    r = passages._near(40)(pa.Table.from_pylist(rows)).to_pylist()
    found, own = {(x["id"], x["other"]) for x in r}, stretches()
    near = [w[40 - passages.MARGIN : 54 + passages.MARGIN] for w in own]
    alike = {(i, j) for i in range(60) for j in range(i) if passages.in_order(near[i], near[j]) >= 40}
    assert alike <= found and len(alike) > 100 and len(found) < 1.1 * len(alike)


def test_words_shared_near_chains():
    own, r = stretches(), random.Random(4)
    a = passages.half(own[0])
    start, end = np.array([0, 10, 40, 89]), np.array([20, 60, 54, 95])
    others = [passages.half(own[k])[: r.randint(0, 90)] for k in (3, 6, 1, 0)]
    got = passages.shared_words(a, start, end, np.concatenate(others), np.array([len(x) for x in others]))
    assert got.tolist() == [int(np.isin(o, a[s:e]).sum()) for o, s, e in zip(others, start, end, strict=True)]


def test_keys_are_known_by_their_bits(spark):
    r = np.random.default_rng(1)
    keys = [int(x) for x in r.integers(-(1 << 63), (1 << 63) - 1, 500)]
    bits = passages._bits(spark.createDataFrame([(k,) for k in keys], "key long"), 500)
    assert passages._among(np.array(keys), bits).all() and passages._among(r.integers(-(1 << 63), (1 << 63) - 1, 10_000), bits).mean() < 0.01
