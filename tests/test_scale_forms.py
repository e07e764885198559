"""Forms of operators that keep to bounds at scale, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tabweave import catalogue
from tabweave.operators import folds, joins, profile, ranges, sort
from tabweave.plans.config import Config
from tabweave.plans.engine import Engine
from tabweave.sources import scan


def test_bounded_profile(spark):
    rows = [(str(i), "NULL" if i % 7 == 0 else f"v{i % 5}", " " if i % 3 else str(i / 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    plain = {r["column"]: r.asDict() for r in profile.profile(df).collect()}
    same = {r["column"]: r.asDict() for r in profile.bounded(df).collect()}
    for c, want in plain.items():
        assert same[c]["distinct_exact"] and {k: same[c][k] for k in want} == pytest.approx(want) if c == "c" else {k: same[c][k] for k in want} == want
    few = {r["column"]: r for r in profile.bounded(df, most=100).collect()}
    assert few["a"]["distinct_count"] == 100 and not few["a"]["distinct_exact"] and few["a"]["unique"] is None and abs(few["a"]["distinct_estimate"] - 600) < 30
    assert few["b"]["distinct_exact"] and few["b"]["distinct_count"] == 5 and few["b"]["null_count"] == 86
    assert profile.bounded(df, most=599).where("column = 'a'").first()["distinct_count"] == 599 and profile.bounded(df, most=600).where("column = 'a'").first()["distinct_exact"]
    assert [r["type"] for r in profile.bounded(df.limit(0)).collect()] == ["empty"] * 3


@pytest.mark.parametrize("how", ["inner", "left", "semi"])
def test_interval_join(spark, how):
    rng = random.Random(5)
    points = [(i, rng.choice([None, rng.uniform(-50, 50), float(rng.randrange(-5, 5))]), i % 3) for i in range(120)]
    spans = [(100 + i, *rng.choice([(None, 1.0), (rng.uniform(-60, 60), None), (3.0, 2.0), (a := rng.uniform(-60, 60), a), (b := float(rng.randrange(-5, 5)), b + rng.choice([1.0, 2.0, 64.0, 1000.0])), (c := rng.uniform(-60, 60), c + rng.uniform(0, 20))]), i % 3) for i in range(90)]
    p, s = spark.createDataFrame(points, "id int, at double, k int"), spark.createDataFrame(spans, "sid int, low double, high double, k int")
    met = [(x, y) for x in points for y in spans if x[1] is not None and None not in y[1:3] and y[1] <= x[1] <= y[2] and x[2] == y[3]]
    if how == "semi":
        want = sorted({x for x, _ in met})
    else:
        want = [(*x, *y[:3]) for x, y in met] + ([(*x, None, None, None) for x in points if x not in {m[0] for m in met}] if how == "left" else [])
    for width in (None, 3.0):
        got = ranges.interval_join(p, s, "at", "low", "high", ["k"], how, width)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in ranges.interval_join(p, s.drop("k"), "at", "low", "high", how=how)._jdf.queryExecution().toString()


def test_sums_of_text_equal_the_fold(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice(["", "1", "2.5", "-3", "word", "1e2", " ", None])) for k in range(60) for i in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(folds.folded(F.col("v"), df.schema["v"].dataType, F.col("i"), "sum").alias("s")).collect()}
    step = spark.createDataFrame([(a, b) for a in ("", "1", "3.5", "word", " ") for b in ("", "1", "2.5", "x", " ")], "a string, b string")
    two = {(r["a"], r["b"]): r["s"] for r in step.select("a", "b", folds.step(F.col("a"), F.col("b"), "sum").alias("s")).collect()}
    pairs = spark.createDataFrame([(j, i, v) for j, p in enumerate(two) for i, v in enumerate(p)], "k int, i int, v string")
    folded = {r["k"]: r["s"] for r in pairs.groupBy("k").agg(folds.folded(F.col("v"), pairs.schema["v"].dataType, F.col("i"), "sum").alias("s")).collect()}
    assert folded == dict(enumerate(two.values())) and len(got) == 60
    assert "collect_list" not in df.groupBy("k").agg(folds.folded(F.col("v"), df.schema["v"].dataType, F.col("i"), "sum"))._jdf.queryExecution().toString()


def test_row_by_rank(spark, monkeypatch):
    monkeypatch.setattr(profile, "_SORTED", 50)
    rng = random.Random(7)
    rows = sorted((rng.choice(["a", "b", "b", "c", None]), i) for i in range(0)) or [(rng.choice(["a", "b", "b", "c"]), i) for i in range(2000)]
    df, order = spark.createDataFrame(rows, "k string, i int"), sorted(rows)
    for n in (1, 37, 999, 2000):
        assert [tuple(r) for r in profile.inspect_row(df, n, ["k", "i"]).collect()] == [(*order[n - 1], n)]
    assert profile.inspect_row(df, 2001, ["k", "i"]).count() == 0 and profile.inspect_row(df.limit(0), 1, ["k", "i"]).count() == 0


def test_preview_keeps_to_its_budget(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,value\n" + "".join(f'{i},"value\n{i}"\n' for i in range(10_000)))
    e = Engine(spark, Config(dedupe=False))
    assert [r["id"] for r in e.preview([str(path)], rows=5, scan_rows=20, scan_bytes=512).collect()] == [str(i) for i in range(5)]
    # a row has 8 bytes of text at first
    for rows, size, want in ((20, 512, 20), (5000, 80, 10), (5000, 7, 0), (5000, 8, 1), (37, 1 << 20, 37), (20_000, 1 << 30, 10_000)):
        assert sort.fitting(scan.read(spark, str(path)).drop(*scan.HIDDEN), rows, size) == want
    assert e.preview([str(path)], scan_bytes=80).count() == 10 and e.preview([str(path)], columns=1, cell_bytes=1).columns == ["id"]


def test_a_join_that_multiplies_rows_is_dealt_out(spark, tmp_path, monkeypatch):
    for table, rows in {"customer": [(i, i % 3) for i in range(90)], "supplier": [(i, i % 3) for i in range(60)], "nation": [(f"n{i}", i) for i in range(3)]}.items():
        names = {"customer": "c_custkey long, c_nationkey int", "supplier": "s_suppkey long, s_nationkey int", "nation": "n_name string, n_nationkey int"}[table]
        spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    one = catalogue.QUERIES["join_chain"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(one) > 4 and max(r["count"] for r in one) < 600 and sum(r["count"] for r in one) == 1800
    left = spark.createDataFrame([(i % 2 if i % 7 else None, i, "a") for i in range(40)], "k int, n int, _share0 string").coalesce(1)
    right = spark.createDataFrame([(i % 3 if i % 5 else None, -i) for i in range(30)], "k long, m int")
    for how in ("inner", "left", "full"):
        want = sorted(map(str, joins.join(left, right, ["k"], how).collect()))
        for rows in (joins.BROADCAST_ROWS, 0):
            monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
            got = joins.join_many(left, right, ["k"], how)
            assert sorted(map(str, got.collect())) == want and len(want) > 100 and got.columns == joins.join(left, right, ["k"], how).columns
        monkeypatch.undo()
