import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tabweave import cli
from tabweave.plans import sql_lane, workflow
from tabweave.plans.config import Config
from tabweave.plans.engine import Engine
from tabweave.sources import scan, sinks, xlsx
from tabweave.streaming import watch


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_files_to_file(spark, tmp_path):
    a = put(tmp_path / "a.csv", "﻿id;name\r\n0007;\"A;B\"\r\n2; x \r\n")
    b = put(tmp_path / "b.jsonl", '{"id": "0007", "mail": "u@x.org", "n": 1.5}\n\n{"id": 3}\n')
    out = str(tmp_path / "out.csv")
    c = Config(sort=(("id", True),), redact=True, source_column="from")
    stats = Engine(spark, c).process([a, b], out)
    lines = open(out, encoding="utf-8").read().split("\n")
    assert lines[0] == "id,name,from,mail,n" and lines[1:5] == ["2,x,a.csv,,", "3,,b.jsonl,,", "0007,A;B,a.csv,,", "0007,,b.jsonl,[REDACTED],1.5"]
    assert stats["rows_out"] == 4 and json.load(open(f"{out}.manifest.json"))["output"]["sha256"] == sinks.sha256(out)


def test_dedupe_default_and_keep_last(spark, tmp_path):
    a = put(tmp_path / "a.csv", "id,v\n1,a\n1,A\n2,b\n")
    assert Engine(spark).frame([a]).count() == 2
    assert Engine(spark, Config(dedupe=False)).frame([a]).count() == 3


@pytest.mark.parametrize("policy,count", [("warn", 2), ("quarantine", 1)])
def test_ragged_rows(spark, tmp_path, policy, count):
    a = put(tmp_path / "a.csv", "id,name\n1,x\n2\n")
    q = str(tmp_path / "q.jsonl")
    e = Engine(spark, Config(invalid_rows=policy, quarantine=q, manifest=False))
    assert e.process([a], str(tmp_path / "o.csv"))["rows_out"] == count
    assert policy == "warn" or json.loads(open(q).readline())["file"] == a


def test_bad_input_stops_and_leaves_the_old_output(spark, tmp_path):
    a, out = put(tmp_path / "a.csv", "id,name\n1,x\n2\n"), put(tmp_path / "o.csv", "old")
    with pytest.raises(scan.InputError):
        Engine(spark).process([a], out)
    with pytest.raises(scan.InputError):
        Engine(spark, Config(max_rows=1, invalid_rows="warn")).process([a], out)
    assert open(out).read() == "old"


def test_encodings_dialects_and_formats(spark, tmp_path):
    a = put(tmp_path / "a.csv", "id,name\n1,Müller €\n", "cp1252")
    assert scan.detect(a).encoding == "windows-1252"
    e = Engine(spark, Config(manifest=False))
    assert e.frame([a]).select("name").first()[0] == "Müller €"
    for name in ("o.tsv", "o.jsonl", "o.parquet", "o.xlsx", "o.csv"):
        out = str(tmp_path / name)
        e.process([a], out)
        assert [r["name"] for r in Engine(spark).frame([out]).select("name").collect()] == ["Müller €"], name
    out = sinks.write(e.frame([a]).select("id", "name"), str(tmp_path / "w.csv"), encoding="cp1252", quoting="all", line_ending="\r\n")
    assert open(out, "rb").read() == '"id","name"\r\n"1","Müller €"\r\n'.encode("cp1252")
    with pytest.raises(sinks.OutputError):
        sinks.write(e.frame([a]).select("id"), out, collision="fail")


def test_workbook_reads_the_active_sheet(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write(path, ["id", "v"], iter([["1", "a & <b>"], ["2", ""]]))
    assert list(xlsx.rows(path)) == [["id", "v"], ["1", "a & <b>"], ["2", ""]]
    assert scan.read(spark, path).select("id", "v").collect()[0] == ("1", "a & <b>")


def test_parquet_cells_become_text(spark, tmp_path):
    p = str(tmp_path / "p.parquet")
    spark.sql("SELECT '1' AS id, CAST(NULL AS bigint) AS amount UNION ALL SELECT '2', 5").coalesce(1).write.parquet(str(tmp_path / "dir"))
    next((tmp_path / "dir").glob("part-*.parquet")).rename(p)
    assert sorted(tuple(r)[:2] for r in scan.read(spark, p).collect()) == [("1", ""), ("2", "5")]


def test_headers_reports_and_preview(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", "First Name,id\nx,1\n"), put(tmp_path / "b.csv", "id,email\n2,y\n")
    e = Engine(spark, Config(header_normalize="snake_case"))
    report = e.schema_report([a, b])
    assert report["union_columns"] == ["first_name", "id", "email"] and report["common_columns"] == ["id"] and report["files"][a]["types"]["id"] == "number"
    assert e.preview([a, b], rows=1).count() == 1 and {r["column"] for r in e.profile([a]).collect()} == {"first_name", "id"}


def test_contract_repairs_and_reshape_in_a_run(spark, tmp_path):
    a = put(tmp_path / "a.csv", "id,jan,feb\nA,2,3\nB,,5\n")
    c = Config(repairs=({"row": 2, "column": "jan", "expected_old": "", "new_value": "7"},), unpivot=("jan", "feb"), unpivot_name="m", unpivot_value="v", contract={"fields": [{"name": "id", "constraints": {"unique": True}}]})
    assert sorted(tuple(r)[:1] + (r["m"], r["v"]) for r in Engine(spark, c).frame([a]).collect()) == [("A", "feb", "3"), ("A", "jan", "2"), ("B", "feb", "5"), ("B", "jan", "7")]
    assert Engine(spark, Config(contract={"fields": [{"name": "jan", "constraints": {"required": True}}]})).validate([a]).first()["rule"] == "required"


def test_join_and_merge_of_files(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", "id,v\n1,x\n2,y\n"), put(tmp_path / "b.csv", "id,v\n1,z\n3,w\n")
    assert [tuple(r) for r in Engine(spark).join([a, b], ["id"]).collect()] == [("1", "x", "z")]
    assert Engine(spark).merge(a, a, b, ["id"], "ours").count() == 2


def test_order_of_large_text_scans(spark, tmp_path):
    a = put(tmp_path / "a.csv", "id\n" + "".join(f"{i:04d}\n" for i in range(3000)))
    out = str(tmp_path / "o.csv")
    Engine(spark, Config(dedupe=False, manifest=False)).process([a], out)
    assert open(out).read() == open(a).read()


def test_sql_lane(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", "id,name\n001,x\n2,y\n"), put(tmp_path / "b.csv", "id,amount\n1,5\n")
    found, report = Engine(spark).sql([a, b], "SELECT name, amount FROM input_0 JOIN input_1 USING (id) -- note;\n;")
    assert [tuple(r) for r in found] == [("x", "5")] and report.views["input_0"]["id"] == "int"
    for text, code in [("", "empty_query"), ("select 1; select 2", "multiple_statements"), ("drop table input_0", "read_only_required"), ("select 'a", "invalid_query"), ("select ((", "invalid_query"), ("select nothing_such from input_0", "sql_error"), ("with x as (select 1) insert into input_0 select * from x", "read_only_required")]:
        with pytest.raises(sql_lane.SqlError) as e:
            Engine(spark).sql([a], text)
        assert e.value.code == code, text
    with pytest.raises(sql_lane.SqlError, match="TABLE_OR_VIEW_NOT_FOUND"):
        Engine(spark).sql([a], f"SELECT * FROM csv.`{a}`")
    for bounds, code in [({"max_rows": 1}, "result_row_limit"), ({"max_cell_bytes": 0}, "result_cell_limit")]:
        with pytest.raises(sql_lane.SqlError) as e:
            Engine(spark).sql([a], "SELECT * FROM input_0", **bounds)
        assert e.value.code == code
    assert Engine(spark).sql([put(tmp_path / "empty.csv", "")], "SELECT * FROM input_0")[0] == []


def test_sql_timeout_and_cancel(spark):
    slow = spark.range(10**11).select(F.sum(F.sqrt("id")).alias("s"))
    stop = threading.Event()
    threading.Timer(0.3, stop.set).start()
    for options, code in [({"timeout": 0.2}, "query_timeout"), ({"cancel": stop}, "query_cancelled")]:
        began = time.time()
        with pytest.raises(sql_lane.SqlError) as e:
            sql_lane.collected(slow, **options)
        assert e.value.code == code and time.time() - began < 15


def test_workflows(tmp_path):
    c = Config(filters=(("a", "equals", "1"),), sort=(("a", False),))
    doc = workflow.build(c, ["x.csv"], "o.csv")
    path = workflow.save(str(tmp_path / "w.json"), doc)
    assert workflow.replayed(workflow.load(path)) == (c, ["x.csv"], "o.csv")
    changed = json.loads(json.dumps(doc))
    changed["operations"][0]["inputs"] = ["y.csv"]
    for bad in (changed, doc | {"version": 99}):
        with pytest.raises(workflow.WorkflowError):
            workflow.replayed(bad)
    assert workflow.replayed({"version": 1, "config": {"dedupe": False}, "inputs": ["z"], "output": "o"})[0].dedupe is False
    h = workflow.remembered(workflow.remembered(None, doc), doc)
    assert len(h["runs"]) == 1
    u = workflow.Undo(Config())
    u.push(c)
    assert u.undo() == Config() and u.redo() == c


def test_watch_states(tmp_path):
    p = tmp_path / "a.csv"
    put(p, "id\n1\n")
    w = watch.Watch(settle=1)
    look = lambda t: w.observe([watch.signature(str(p))], t)
    assert [look(0), look(0.5), look(1.1)] == ["changed", "settling", "ready"]
    w.finished()
    assert look(2) == "unchanged"
    put(p, "id\n1\n2\n")
    assert look(3) == "changed" and w.observe([], 4) == "waiting"
    p.unlink()
    assert look(5) == "deleted"
    state = w.save(str(tmp_path / "s.json"))
    assert watch.Watch.load(state).done == w.done and watch.Watch.load(state, config="other").done is None


def test_watch_loop_and_stream_signal(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, runs, t = put(tmp_path / "in" / "a.csv", "id\n1\n"), [], iter(range(100))
    assert watch.loop(lambda: [a], lambda: runs.append(1), str(tmp_path / "s.json"), 0, 1, rounds=5, clock=lambda: next(t), sleep=lambda s: None) == 1 and runs == [1]
    for _ in range(2):
        watch.on_change(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda: runs.append(2)).awaitTermination(60)
    assert runs == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    a = put(tmp_path / "a.csv", "id,qty\n1,5\n2,50\n")
    out = str(tmp_path / "o.csv")
    assert cli.main(["--inputs", a, "--output", out, "--filter", "qty:greater_than:10", "--rename", "qty=n", "--no-manifest", "--stats-json", str(tmp_path / "s.json")]) == 0
    assert open(out).read() == "id,n\n2,50\n" and json.load(open(tmp_path / "s.json"))["stats"]["rows_out"] == 1
    assert cli.main(["--inputs", str(tmp_path / "none*.csv"), "--output", out]) == 1 and cli.main(["--unknown"]) == 2
    assert cli.main(["--inputs", a, "--output", out, "--rename", "x=y"]) == 3
    assert cli.main(["--inputs", a, "--output", "-"]) == 0 and "1,5" in capsys.readouterr().out
    assert cli.main(["--inputs", a, "--sql", "SELECT sum(qty) AS q FROM input_0"]) == 0 and '"q": "55"' in capsys.readouterr().out
    wf = str(tmp_path / "w.json")
    assert cli.main(["--inputs", a, "--output", out, "--save-workflow", wf, "--no-manifest"]) == 0 and cli.main(["--replay", wf]) == 0


def test_throughput_floor(spark, tmp_path):
    a = put(tmp_path / "a.csv", "id,v\n" + "".join(f"{i},x{i}\n" for i in range(5000)))
    began = time.time()
    Engine(spark, Config(dedupe=False, manifest=False)).process([a], str(tmp_path / "o.csv"))
    assert time.time() - began < 30


def test_joins_and_merges_keep_their_order(spark, tmp_path):
    from tabweave import cli

    a = put(tmp_path / "a.csv", "id,l\n3,a\n1,b\n,c\n2,d\n3,e\n9,f\n")
    b = put(tmp_path / "b.csv", "id,r\n7,u\n3,v\n2,w\n3,x\n,y\n6,z\n")
    rows = [("3", "a", "v"), ("3", "a", "x"), ("1", "b", ""), ("", "c", ""), ("2", "d", "w"), ("3", "e", "v"), ("3", "e", "x"), ("9", "f", ""), ("7", "", "u"), ("", "", "y"), ("6", "", "z")]
    matched = [r for r in rows if r[1] and r[2]]
    for how, want in (("outer", rows), ("inner", matched), ("left", [r for r in rows if r[1]]), ("right", matched + [r for r in rows if not r[1]])):
        assert [tuple(x or "" for x in r) for r in Engine(spark).join([a, b], ["id"], how).collect()] == want, how
    assert [r["l"] for r in Engine(spark).join([a, b], ["id"], "anti").collect()] == ["b", "c", "f"]
    base = put(tmp_path / "base.csv", "id,v\n5,a\n1,b\n4,c\n")
    ours = put(tmp_path / "ours.csv", "id,v\n9,n\n1,b\n5,changed\n4,c\n8,m\n")
    theirs = put(tmp_path / "theirs.csv", "id,v\n0,t\n4,c\n1,b\n5,a\n")
    want = [("5", "changed"), ("1", "b"), ("4", "c"), ("9", "n"), ("8", "m"), ("0", "t")]
    assert [tuple(r) for r in Engine(spark).merge(base, ours, theirs, ["id"]).collect()] == want
    out = str(tmp_path / "out.csv")
    assert cli.main(["--three-way-base", base, "--three-way-ours", ours, "--three-way-theirs", theirs, "--key-columns", "id", "--output", out]) == 0
    assert open(out).read().split() == ["id,v"] + [",".join(r) for r in want]
    assert cli.main(["--inputs", a, b, "--join-on", "id", "--join-type", "outer", "--output", out]) == 0
    assert open(out).read().splitlines() == ["id,l,r"] + [",".join(r) for r in rows]


def test_sql_lane_refuses_methods_of_the_jvm(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for text in ("SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "select `java_method` /* x */ ('a', 'b')", "WITH t AS (SELECT TRY_REFLECT('a','b') x) SELECT * FROM t",
        "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','user.dir')", "SELECT /* /* */ ' */ reflect('java.lang.System','getProperty','user.dir') --'", "SELECT * FROM input_0 WHERE a IN (SELECT length(reflect('java.lang.System','getProperty','user.dir')))",
        "SELECT r'\\' , reflect('java.lang.System','getProperty','user.dir') AS `'`", "SELECT * FROM input_0 WHERE EXISTS (SELECT 1 FROM csv.`/etc/hostname`)", "SELECT * FROM IDENTIFIER('csv.`/etc/hostname`')"):
        with pytest.raises(sql_lane.SqlError):
            sql_lane.query([df], text)
    assert sql_lane.query([df], "SELECT 'reflect(' AS x -- java_method(")[0].count() == 1
