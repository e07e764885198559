"""Delimited text in many splits equals the reading of the whole, with lines and reasons of bad rows."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tabweave.plans import engine
from tabweave.plans.config import Config
from tabweave.plans.engine import Engine
from tabweave.sources import delimited, files, scan, sinks


@pytest.fixture
def small_splits(spark):
    """Splits of 200 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def table(seed, n, feed="\n"):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(['a', 'b c', '"', ",", feed, '""', "é", "x" * 9, "", ' "', "line" + feed + feed]) for _ in range(rng.choice([0, 1, 2, 3, 6, 90 if rng.random() < 0.05 else 1])))
    return [[str(i), cell(), cell()] for i in range(n)]


@pytest.mark.parametrize(("seed", "feed"), [(0, "\n"), (1, "\r\n")])
def test_quoted_line_breaks_over_splits(spark, tmp_path, small_splits, seed, feed):
    rows, out = table(seed, 60, feed), io.StringIO()
    csv.writer(out, lineterminator=feed).writerows([["id", "a", "b"], *rows])
    path = put(tmp_path / "t.csv", out.getvalue())
    df = scan.read(spark, path, trim=False)
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    got = df.orderBy("_ord").collect()
    assert [[r["id"], r["a"], r["b"]] for r in got] == rows and all(r["_bad"] is None for r in got)
    # lines are those of the file, and equal to what a reader of the whole counts
    reader, lines, before = csv.reader(io.StringIO(out.getvalue(), newline="")), [], 1
    for _ in reader:
        lines.append(before)
        before = reader.line_num + 1
    assert [r["_ord"]["b"] for r in got] == lines[1:]


def test_same_rows_as_the_reader_of_one_piece(spark, tmp_path, small_splits):
    text = 'id,a,b\n1,x"y,2\n2,"q""q",\n3,"un,quoted" tail,4\n\n4, lead,"  in  "\n5,"' + "long\n" * 100 + '",end\n6,7"8,9\n'
    path = put(tmp_path / "t.csv", text)
    whole = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False).fillna("").collect()
    got = scan.read(spark, path, trim=False).orderBy("_ord").drop(*scan.HIDDEN).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in whole] and len(got) == 6


def test_lines_and_reasons_of_bad_rows(spark, tmp_path, small_splits):
    good = "".join(f'{i},"a\nb"\n' for i in range(60))
    path = put(tmp_path / "t.csv", b"id,v\n" + good.encode() + b"short\n" + good.encode() + b"1,2,3\n7,\xff\xfe\n" + good.encode() + b'8,"never closed\nand on\n')
    df = scan.read(spark, path)
    _, bad = scan.judged(df, "quarantine")
    found = [(r["line"], r["reason"]) for r in bad.orderBy("_ord").collect()]
    assert found == [(122, scan.RAGGED), (243, scan.RAGGED), (244, delimited.ENCODING), (365, delimited.OPEN)]
    lines = b"".join([b'{"a": 1}\n'] * 90 + [b"[1]\n", b"\n", b"{broken\n"] + [b'{"a": 2}\n'] * 90)
    path = put(tmp_path / "t.jsonl", lines)
    good, bad = scan.judged(scan.read(spark, path), "quarantine", True)
    assert [(r["line"], r["reason"], r["raw"]) for r in bad.orderBy("_ord").collect()] == [(91, scan.NOT_OBJECT, "[1]"), (93, scan.NOT_JSON, "{broken")] and good.count() == 180
    q = str(tmp_path / "q.jsonl")
    Engine(spark, Config(invalid_rows="quarantine", quarantine=q, manifest=False)).process([path], str(tmp_path / "o.csv"))
    assert json.loads(open(q).readline()) == {"file": path, "line": 91, "reason": scan.NOT_OBJECT, "raw": "[1]"}
    with pytest.raises(scan.InputError, match="line 91"):
        scan.judged(scan.read(spark, path), "fail")


def test_states_compose(spark):
    rng = random.Random(4)
    lines = [bytes(rng.choice(b'a",') for _ in range(rng.randrange(8))) for _ in range(300)]
    inside, states = False, []
    for x in lines:
        inside = delimited.step(x, inside, b",")[0]
        states.append(inside)
    for cuts in (sorted(rng.sample(range(1, 300), 12)) for _ in range(20)):
        found = []
        for a, b in zip([0, *cuts], [*cuts, 300], strict=True):
            ends, some = [False, True], [False, False]
            for x in lines[a:b]:
                ends = [delimited.step(x, s, b",")[0] for s in ends]
                some = [c or not s for c, s in zip(some, ends, strict=True)]
            found.append({"block": a, "n": b - a, "ends": ends, "cuts": some})
        begin, last = delimited.starts(found)
        assert [b[1] for b in begin] == [False, *[states[c - 1] for c in cuts]] and (last is not None) == states[-1]


@pytest.mark.parametrize("encoding", ["windows-1252", "iso-8859-1", "utf-16", "utf-8-sig"])
def test_encodings(spark, tmp_path, small_splits, encoding):
    rows = [[str(i), f'Müller\n"{i}"'] for i in range(40)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "näme"], *rows])
    path = put(tmp_path / "t.csv", out.getvalue().encode({"windows-1252": "cp1252"}.get(encoding, encoding)))
    got = scan.read(spark, path).orderBy("_ord").collect()
    assert got[0].__fields__[:2] == ["id", "näme"] and [[r["id"], r["näme"]] for r in got] == rows
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_carriage_returns_alone_end_lines(spark, tmp_path):
    assert [tuple(r)[:2] for r in scan.read(spark, put(tmp_path / "t.csv", "a,b\r1,2\r3,4\r")).orderBy("_ord").collect()] == [("1", "2"), ("3", "4")]


def test_odd_files(spark, tmp_path):
    assert scan.read(spark, put(tmp_path / "empty.csv", "")).count() == 0
    assert scan.read(spark, put(tmp_path / "head.csv", "a,b\n")).columns[:2] == ["a", "b"]
    assert [tuple(r)[:1] for r in scan.read(spark, put(tmp_path / "gap.csv", "\n\n a\n\n1\n2")).orderBy("_ord").collect()] == [("1",), ("2",)]


def test_folders_and_uris(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    a, b = put(tmp_path / "in" / "b.csv", "id\n1\n"), put(tmp_path / "in" / "deep" / "A.jsonl", '{"id": 2}\n')
    put(tmp_path / "in" / "note.md", "x")
    assert scan.expand([str(tmp_path / "in")]) == sorted([a, b], key=str.lower)
    assert scan.expand([f"file://{tmp_path}/in"]) == scan.expand([f"file:{tmp_path}/in"]) == sorted([a, b], key=str.lower)
    assert scan.expand([str(tmp_path / "in")], recursive=False) == [a] and scan.expand([str(tmp_path / "*" / "*.csv"), a]) == [a] and scan.expand([str(tmp_path / "no*")]) == []
    uri = f"file://{a}"
    assert scan.expand([uri]) == [uri] and [r["id"] for r in Engine(spark).frame([uri]).collect()] == ["1"]
    assert files.length(spark, uri) == 5 and files.suffix("s3a://x/y.Z/part.CSV") == ".csv" and files.suffix("/x.y/part") == ""


def test_types_of_a_file(spark, tmp_path, small_splits):
    text = "i,l,d,t,day,b,s,none\n" + "".join(f'{i},{i}000000000000,{i}.5,2020-01-{i % 28 + 1:02d} 10:00:00,2020-01-02,true,"a\n{i}",\n' for i in range(60))
    df = engine.typed(spark, put(tmp_path / "t.csv", text))
    assert dict(df.dtypes) == {"i": "int", "l": "bigint", "d": "double", "t": "timestamp_ntz", "day": "date", "b": "boolean", "s": "string", "none": "string"}
    assert df.where("b and i >= 30").count() == 30 and df.where("none is null").count() == 60
    with pytest.raises(scan.InputError):
        engine.typed(spark, put(tmp_path / "bad.csv", "a,b\n1\n"))


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet"])
def test_folders_are_written_by_all_tasks_and_put_in_place(spark, tmp_path, kind):
    uri = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(i, f'a "{i}"\n, b', "" if i % 3 else " x ") for i in range(200)], "id long, v string, w string").repartition(5)
    sinks.write_folder(df, uri, kind)
    found = scan.expand([uri], parts=True)
    got, _ = scan.read_all(spark, found, trim=False)
    assert len(found) == 5 and sorted(tuple(r)[:3] for r in got.select("id", "v", "w").collect()) == sorted((str(a), b, c) for a, b, c in df.collect())
    fails = df.withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_folder(fails, uri, kind)
    # the old output stays, and nothing else does
    assert scan.expand([uri], parts=True) == found and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(sinks.OutputError):
        sinks.write_folder(df, uri, kind, collision="fail")
    sinks.write_folder(df.limit(3), uri, kind, collision="backup")
    assert scan.read_all(spark, scan.expand([uri], parts=True))[0].count() == 3 and len(list(tmp_path.iterdir())) == 2


def _depth(v) -> int:
    inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else None
    return 1 + max(map(_depth, inner)) if inner else 0


def test_depth_of_json(spark):
    r = random.Random(9)

    def some(n):
        kind = r.randrange(4) if n else 3
        if kind == 0:
            return {r.choice(["a", 'b"[', "c\\\\{"]) + str(i): some(n - 1) for i in range(r.randrange(3))}
        return [some(n - 1) for _ in range(r.randrange(3))] if kind < 3 else r.choice([1, None, '[[[["{{', "\\", '\\"]'])

    values = [some(r.randrange(7)) for _ in range(300)] + [[[[[]]]], {}, "[", [""], [[""], {}]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, value string")
    for depth in (0, 1, 3):
        got = {x["i"] for x in rows.where(scan.deeper(F.col("value"), depth)).collect()}
        assert got == {i for i, v in enumerate(values) if _depth(v) > depth}


def test_bounds_of_depth_and_unpacked_bytes(spark, tmp_path):
    deep, out = tmp_path / "deep.jsonl", tmp_path / "out.csv"
    deep.write_text('{"a": 1}\n' + '{"a": "[[[["}\n' + '{"a": ' + "[" * 40 + "]" * 40 + "}\n" + '{"a": "' + 'x\\"' * 20000 + '"}\n')
    with pytest.raises(scan.InputError, match="more than 32 levels; first in line 3"):
        Engine(spark, Config()).process([str(deep)], str(out))
    book = tmp_path / "book.xlsx"
    from tabweave.sources import xlsx

    xlsx.write(str(book), ["a"], iter([["x" * 1000]] * 50))
    with pytest.raises(scan.InputError, match="unpacks to more than 20000 bytes"):
        Engine(spark, Config(max_decompressed_bytes=20_000)).process([str(book)], str(out))
    assert not out.exists()
    Engine(spark, Config(max_json_nesting=41)).process([str(deep)], str(out))
    assert out.exists()
    assert scan.read_all(spark, [str(book)], limits=scan.Limits())[0].count() == 50
