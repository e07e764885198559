import json
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tabweave.llm import mixing, repetition, topk, toxicity


def test_longest_repeats_against_all_pairs():
    r = random.Random(1)
    for _ in range(100):
        docs = [[r.randint(0, 2) for _ in range(r.randint(0, 14))] for _ in range(5)]
        got = repetition.longest_repeats(np.array(sum(docs, []), np.int64), np.repeat(np.arange(5), [len(x) for x in docs])).tolist()
        want = []
        for x in docs:
            for i in range(len(x)):
                best = 0
                for j in range(len(x)):
                    k = 0
                    while i != j and i + k < len(x) and j + k < len(x) and x[i + k] == x[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert got == want


def test_quality_figures(make_docs, clashes):
    clean = " ".join(f"w{i}" for i in range(80))
    long = " ".join(f"v{i}" for i in range(70))
    rows = [(1, clean), (2, None), (3, ""), (4, "a b c\n\na b c\n x#$ a b c"), (5, long + " " + long), (6, "é\xa0ü *\x1c|"), (1, clean), (7, "spam ham " * 20000)]
    out = {r["doc_id"]: r.asDict() for r in repetition.quality(make_docs(rows, clashes)).collect()}
    assert out[1]["kept"] and not out[1]["base_failed"] and out[2]["base_failed"] and out[3]["n_words"] == 0
    four = out[4]
    assert (four["n_words"], four["word_chars"], four["n_symbols"], four["n_dup_lines"], four["n_repeat_words"]) == (10, 12, 2, 1, 9)
    assert out[5]["longest_repeat"] == 70 and out[5]["covered_fraction"] == 1.0 and not out[5]["kept"]
    assert (out[6]["n_words"], out[6]["word_chars"], out[6]["n_symbols"]) == (2, 6, 2) and out[7]["base_failed"]
    assert repetition.quality(make_docs([])).count() == 0 and repetition.quality(make_docs(rows)).count() == 8


def targets(sizes, weights, share=1.5, cap=2.0):
    """Excess is dealt out again until none is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        t = {s: cap * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in sizes}
        over = [s for s in free if t[s] > cap * sizes[s] + 1e-9]
        if not over:
            return t
        capped |= set(over)


def mix_docs(make_docs, clashes, n=600):
    r = random.Random(2)
    rows = [(i, " ".join(["x"] * r.randint(0, 40)), r.choice(["a", "b", "B", "é", None] + ["hot"] * 4)) for i in range(n)]
    return rows, make_docs(rows, clashes)


def test_mix(make_docs, clashes):
    rows, docs = mix_docs(make_docs, clashes)
    measured = mixing.measure(docs)
    out = mixing.apply(measured, mixing.cutoffs(measured)).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want = targets(sizes, (3, 1, 2))
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.apply(measured, mixing.cutoffs(measured)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}
    copies = mixing.mixed(docs)
    assert {r[0] for r in copies.select("size").distinct().collect()} == {"clash"}
    assert copies.columns == docs.columns and copies.agg(F.sum(F.size(F.split("text", " ")))).first()[0] >= sum(taken.values()) - 1


def test_rows_of_one_key_and_text_come_near_the_target(make_docs):
    rows = [(None, f"{'x ' * 95}{i % 50}", "a") for i in range(50)] + [(7, "y " * 10, "b") for _ in range(333)] + [(i, "z " * 500, None) for i in range(20)]
    for n in (1, 5):
        docs = make_docs(rows).repartition(n)
        measured = mixing.keep(mixing.measure(docs))
        out = mixing.apply(measured, mixing.cutoffs(measured)).collect()
        assert len(out) == len(rows)
        for s, each in (("a", 96), ("b", 10), (None, 500)):
            own = [r for r in out if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= each / 2 + 1e-6 and all(r["taken"] <= 2 * r["size"] for r in own)
        assert mixing.mixed(docs).columns == docs.columns


def test_mix_edge_tables(make_docs):
    for rows in ([], [(1, None, None)], [(1, "", "a"), (1, "", "a")], [(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)]):
        d = mixing.measure(make_docs(rows))
        assert mixing.apply(d, mixing.cutoffs(d)).count() == len(rows) and mixing.mixed(make_docs(rows)).count() >= 0


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as score", "2 as rank", "3 as id", "4 as v", "5 as block", "6 as home", "7 as far")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **options).collect())


def all_pairs(rows, k=5):
    v = {}
    for i, x, _ in rows:
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            v.setdefault(i, []).append([int(np.floor(256 * float(np.float32(c)))) for c in x])
    out = []
    for q in (i for i in v if i % 50 == 0):
        x = min(v[q])
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, ys in v.items() if j != q for y in ys if len(y) == len(x))
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_against_all_pairs(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * r.normal(size=8)).tolist(), 0) for i in range(1500)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(300)]  # one vector many times
    rows += [(3000, None, 0), (3001, [None] + [0.0] * 7, 0), (3002, [float("nan")] * 8, 0), (3003, [float("inf")] * 8, 0), (3050, [0.5], 0), (3051, [0.25], 0), (50, rows[7][1], 0)]
    rows = [(i, [float(np.float32(c)) if c is not None else None for c in x] if x else None, y) for i, x, y in rows]
    want = all_pairs(rows)
    assert search(spark, rows) == want
    assert search(spark, rows, data_block=200, query_block=7) == want


def test_covering_and_nesting_of_the_trees():
    r = np.random.default_rng(8)
    x = np.floor(256 * np.concatenate([r.normal(size=(3000, 6)), np.zeros((400, 6))]))

    def look(node):
        far = np.sqrt(((x[node.at] - node.centre) ** 2).sum(1))
        assert far.max() <= node.radius + 1e-6 and any((x[i] == node.centre).all() for i in node.at)
        if node.children:
            assert sorted(np.concatenate([c.at for c in node.children]).tolist()) == sorted(node.at.tolist())
            apart = [np.sqrt(((a.centre - b.centre) ** 2).sum()) for i, a in enumerate(node.children) for b in node.children[:i]]
            assert min(apart, default=np.inf) > node.radius / topk.SHRINK - 1e-6
            assert len(node.children) == topk.FAN or all(c.radius <= node.radius / topk.SHRINK + 1e-6 for c in node.children)
        else:
            assert len(node.at) <= topk.LEAF or node.radius == 0
        for c in node.children:
            look(c)

    look(topk.build(x, np.arange(len(x)), 0))


def test_thresholds_keep_queries_from_far_blocks():
    """A threshold that no score of a far block reaches leaves nothing of it to visit; a lower one leaves no more than none does."""
    r = np.random.default_rng(9)
    centres = 20 * r.normal(size=(8, 4))
    data = np.floor(256 * np.repeat(centres, 500, 0) + r.normal(size=(4000, 4)))
    best = np.sort(data[:100] @ data.T, axis=1)
    visited = []
    for worst in (None, best[:, -200], best[:, -1] * 2):
        s = topk.Search(data[:100], np.arange(100), data[500:], np.arange(500, 4000), 5, worst)
        s.run()
        visited.append(s.visited)
    assert visited[0] >= visited[1] and visited[2] == 0


def test_top_k_prunes_and_edge_tables(spark):
    r = np.random.default_rng(4)
    centres = 20 * r.normal(size=(8, 4))
    data = np.floor(256 * np.repeat(centres, 2000, 0) + r.normal(size=(16000, 4)))
    s = topk.Search(data[:200], np.arange(200), data, np.arange(16000), 5)
    s.run()
    assert s.visited < 0.5 * 200 * 16000
    best = data[:200] @ data.T
    assert all(-s.best[i][0][0] == max(best[i, j] for j in range(16000) if j != i) for i in range(0, 200, 20))
    assert search(spark, []) == [] and search(spark, [(50, [1.0], 0)]) == []


TOXIC = ["grubwort", "snarlfink", "moglump", "vextil"]


def labelled(n=700):
    r, rows, labels = random.Random(5), [], []
    for i in range(n):
        w = [r.choice(["alpha", "river", "stone", "candle", "window", "garden", "silver", "market"]) + str(r.randint(0, 30)) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                w[r.randrange(60)] = r.choice(TOXIC) + r.choice(["", "en", "ist"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, make_docs, clashes):
    rows, labels = labelled()
    given = spark.createDataFrame(labels + labels[:5] + [(10**6, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = make_docs(rows + [(5000, None), (5001, ""), (None, "x"), (1, rows[1][1]), (5002, "moglump " * 9000)], [c for c in clashes if c != "score"])
    out = toxicity.score(docs, toxicity.fit(docs, given)).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(labels)
    test = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(test) > 80 and sum(a == b for a, b in test) / len(test) > 0.9
    kept = toxicity.filtered(docs, toxicity.fit(docs, given))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and None in ids and 5000 in ids and sum(truth.get(i, 0) for i in ids) < 0.2 * sum(truth.values())


def test_stems_that_chance_explains_are_not_toxic():
    r = random.Random(3)
    text = lambda extra: [f"w{r.randrange(400):03d}x".encode() for _ in range(40)] + extra
    toxic, ordinary = [text([b"grubble"] if i % 2 else [b"%02dxyzzy" % i]) for i in range(60)], [text([]) for _ in range(300)]
    stems = toxicity.toxic_stems(toxic, ordinary)
    assert {s for s in stems if not any(s[:n] in stems for n in range(4, len(s)))} == {b"grub"}
    assert toxicity.toxic_stems([], []) == frozenset()


def test_toxicity_on_held_out_rows_of_the_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.score(own, toxicity.fit(own, labels)).where("held_out").join(labels, "doc_id").select("toxic", "score").toPandas()
    bad, fine = out.score[out.toxic == 1], out.score[out.toxic == 0]
    assert (bad >= 0.5).mean() >= 0.8 and (fine >= 0.5).mean() < 0.01
    assert np.mean([(s > fine).mean() + (s == fine).mean() / 2 for s in bad]) > 0.97


def test_toxicity_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(make_docs([(1, "a")]), none)
    assert [r["score"] for r in toxicity.score(make_docs([(1, "a"), (2, None)]), m).collect()] == [0.0, 0.0]
    assert toxicity.score(make_docs([]), m).count() == 0 and toxicity.filtered(make_docs([(1, "a")]), m).count() == 1
    assert json.dumps(m.weights) == "[]"
