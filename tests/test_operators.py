import pytest
from pyspark.sql import functions as F

from tabweave.functions import similarity
from tabweave.functions import text as X
from tabweave.operators import compute, contract, dedupe, filters, joins, merge, profile, project, repair, reshape, sort, transforms


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fuzzy_dedupe_keeps_first_of_each_cluster(spark):
    df = frame(spark, ["n", "name"], [("1", "Acme Inc"), ("2", "Acme Incorporated"), ("3", "Contoso")])
    assert sorted(rows(dedupe.fuzzy(df, ["name"], 80, ["n"]))) == [("1", "Acme Inc"), ("3", "Contoso")]
    with pytest.raises(ValueError):
        dedupe.fuzzy(df, ["name"], 80, ["n"], block_rows=2)


def test_fuzzy_dedupe_is_that_of_all_pairs_in_order(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(0, 24))) for _ in range(30)]
    names = []
    for _ in range(300):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            t.insert(r.randint(0, len(t)), r.choice("abcdeXY"))
        names.append("".join(t)[r.randint(0, 3) :])
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "n long, name string")
    for threshold in (50, 80, 90, 97):
        best = []
        for i, n in enumerate(names):
            if n and not any(similarity.score(n, names[k]) >= threshold for k in best):
                best.append(i)
        for size in (7, 4000):
            if size == 4000 or threshold == 90:
                found = dedupe.fuzzy(df.where("name <> ''"), ["name"], threshold, ["n"], round_rows=size)
                assert sorted(x["n"] for x in found.collect()) == best


def test_fuzzy_dedupe_of_a_large_table(spark):
    df = spark.range(60_000).selectExpr("id AS n", "concat('name ', id % 3) AS name")
    assert sorted(r["n"] for r in dedupe.fuzzy(df, ["name"], 95, ["n"]).collect()) == [0, 1, 2]


def test_fuzzy_query_is_over_the_whole_table(spark, sf_dir):
    from tabweave import catalogue

    names = [r["p_name"] for r in catalogue.QUERIES["fuzzy_dedupe"](spark, sf_dir).collect()]
    assert names and not any(similarity.score(a, b) >= 90 for i, a in enumerate(names) for b in names[:i])


def test_partial_ratio():
    assert similarity.score("", "x") == 100 and similarity.score("ABC", "xabcx") == 100
    assert similarity.partial_ratio("abcd", "xxabed") == 75 and similarity.partial_ratio("abc", "xyz") == 0


def test_blanks_match_fuzzy_filters(spark):
    df = frame(spark, ["v"], [("",), ("Widgett",), ("zzz",)])
    assert rows(filters.apply(df, [("v", "fuzzy", "widget|80")])) == [("",), ("Widgett",)]
    assert rows(filters.apply(df, [("v", "fuzzy", "|80")])) == []


def test_filters_on_text(spark):
    df = frame(spark, ["v"], [(None,), (" ",), ("1,200",), ("1_000",), ("1d",), ("inf",), ("abc",), ("ABC",)])
    pick = lambda op, value="": [r[0] for r in rows(filters.apply(df, [("v", op, value)]))]
    assert pick("is_empty") == [None, " "] and pick("equals", "abc") == ["abc", "ABC"]
    assert pick("greater_than", "999") == ["1,200", "1_000", "inf"] and pick("between", "1000|1200") == ["1,200", "1_000"]
    assert pick("between", "1000") == [] and pick("unknown", "x") == [r[0] for r in rows(df)] and pick("greater_than", "x") == []
    assert pick("not_in_list", "abc, 1D") == [None, " ", "1,200", "1_000", "inf"] and pick("regex", "^a.c$") == ["abc", "ABC"]
    assert [r[0] for r in rows(filters.apply(df, [("absent", "equals", "")]))] == [r[0] for r in rows(df)]
    with pytest.raises(Exception):
        filters.apply(df, [("v", "regex", "(")])


def test_between_dates(spark):
    df = frame(spark, ["name", "date"], [("A", "2024-02-15"), ("B", "2024-04-01"), ("C", "02/20/2024"), ("D", "Feb 3, 2024"), ("E", "x")])
    assert [r[0] for r in rows(filters.apply(df, [("date", "between", "2024-02-01..2024-03-01")]))] == ["A", "C", "D"]


def test_timestamps(spark):
    given = {"20240215": "2024-02-15 00:00:00", "2024-02-15T08:30Z": "2024-02-15 08:30:00", "2024-02-15 08": "2024-02-15 08:00:00", "2024-02-15T10:00:00+02:00": "2024-02-15 08:00:00", "13/02/2024": "2024-02-13 00:00:00", "2024-02": None, "08:30": None, "Thu, 15 Feb 2024 08:30:00 +0000": "2024-02-15 08:30:00", "15 February 2024": "2024-02-15 00:00:00", "2024-02-15 08:30:01.250000": "2024-02-15 08:30:01.25"}
    df = frame(spark, ["v"], [(v,) for v in given])
    assert {r[0]: r[1] for r in rows(df.select("v", X.as_timestamp(F.col("v")).cast("string")))} == given


def test_text_of_typed_cells(spark):
    df = spark.sql("SELECT true AS b, 1e10D AS d, 0.0001D AS s, 1e16D AS g, 0.1D AS f, 1e-7D AS t, timestamp_ntz'2024-01-01 00:00:00' AS ts, timestamp_ntz'2024-01-01 00:00:00.5' AS tf, 5 AS i, CAST(NULL AS string) AS n")
    assert rows(df.select(*[X.text(df, c) for c in df.columns]))[0] == ("True", "10000000000.0", "0.0001", "1e+16", "0.1", "1e-07", "2024-01-01T00:00:00", "2024-01-01T00:00:00.500000", "5", "")


def test_title_and_strip(spark):
    df = frame(spark, ["v"], [("\t o'neil abc1def \n",)])
    assert rows(df.select(X.title(X.strip(F.col("v"))))) == [("O'Neil Abc1Def",)]


def test_compute(spark):
    df = frame(spark, ["qty", "price", "a", "b"], [("2", "3", "x", "y"), ("1,000", "0.5", "", "z"), ("n", "1", "p", "q")])
    cell = lambda n: X.text(df, n)
    one = lambda e: [r[0] for r in rows(df.select(compute.column(e, cell)))]
    assert one("{qty} * {price}") == ["6", "500", ""] and one("{a} * 2") == ["xx", "", "pp"] and one("{a} + ' ' + {b}") == ["x y", " z", "p q"]
    assert one("round({price} / 2, 1)") == ["1.5", "0.2", "0.5"] and one("{qty} / 0") == ["", "", ""]
    assert one("__import__('os').system('true')") == ["", "", ""] and one("{qty}.upper()") == ["", "", ""] and one("(") == ["", "", ""]
    assert one("max({price}, 2) ** 2") == ["9", "4", "4"] and one("len({a})") == ["1", "0", "1"]


def test_transforms_read_the_row_as_it_came_in(spark):
    df = frame(spark, ["name", "n"], [(" a-b ", "1")])
    out = transforms.apply(df, [("name", "upper"), ("name", "trim"), ("name", "split", "-", 3), ("both", "merge", "+", "name", "n"), ("twice", "compute", "{n} * 2")], renames={"name": "label"})
    assert out.columns == ["label", "n", "name_1", "name_2", "name_3", "both", "twice"] and rows(out) == [("A-B", "1", "a", "b", "", " a-b +1", "2")]
    assert rows(transforms.apply(df, [("name", "regex_replace", r"(\w)-(\w)", r"\2$\1")], case="lower"))[0][0] == " b$a "
    assert rows(transforms.apply(df, [("name", "regex_replace", "(", "x")]))[0][0] == " a-b "


def test_redaction(spark):
    df = frame(spark, ["E-Mail", "x"], [("", "123-45-6789"), ("a", "4111111111111111"), ("b", "u@x.org"), ("c", "plain")])
    assert rows(transforms.redact(df, "#")) == [("#", "#"), ("#", "#"), ("#", "#"), ("#", "plain")]


def test_folds(spark):
    df = frame(spark, ["k", "o", "v"], [("1", "1", "a"), ("1", "2", "b"), ("1", "3", "a"), ("2", "1", "2"), ("2", "2", "3.5"), ("2", "3", "x")])
    out = lambda mode: {r[0]: r[2] for r in rows(dedupe.aggregate(df, ["k", "o"][:1], mode, ["o"]))}
    assert out("concat") == {"1": "a; b; a", "2": "2; 3.5; x"} and out("sum") == {"1": "a", "2": "5.5"}
    assert out("max") == {"1": "b", "2": "x"} and out("min") == {"1": "a", "2": "2"}


def test_dedupe_variants(spark):
    df = frame(spark, ["id", "v", "o"], [("A", "1", "1"), ("a", "2", "2"), ("b", "3", "3")])
    assert sorted(rows(dedupe.distinct(df, ["id"], "first", ["o"]))) == [("A", "1", "1"), ("b", "3", "3")]
    assert sorted(rows(dedupe.distinct(df, ["id"], "last", ["o"], position="p").select("id", "p.o"))) == [("a", "1"), ("b", "3")]
    assert len(rows(dedupe.distinct(df, ["id"], order_by=["o"], case_sensitive=True))) == 3
    assert rows(dedupe.preview(df, ["id"], ["o"], keep="last").select("id", "n_rows", "kept.o")) == [("a", 2, "2")]


def test_sort_of_mixed_cells(spark):
    df = frame(spark, ["v"], [("b",), ("10",), ("9",), ("2024-01-02",), ("",), ("A",), ("2023-12-31",)])
    assert [r[0] for r in rows(sort.sort(df, [("v", True)]))] == ["9", "10", "2023-12-31", "2024-01-02", "", "A", "b"]
    assert [r[0] for r in rows(sort.sort(df, [("v", False)]))][:2] == ["b", "A"]
    assert [r[0] for r in rows(sort.sort(df, [("v", True)], numeric_aware=False))][:2] == ["", "10"]


def test_bounds_and_clips(spark):
    df = frame(spark, ["v"], [("é" * 10,), ("abc",)])
    assert [r[0] for r in rows(sort.preview(df, cell_bytes=5))] == ["éé…", "abc"]
    with pytest.raises(OverflowError):
        sort.bounded(df, 1)


def test_reshape(spark):
    df = frame(spark, ["id", "jan", "feb"], [("A", "2", "3")])
    assert rows(reshape.unpivot(df, ["id"], ["jan", "feb", "absent"], "month", "amount")) == [("A", "jan", "2"), ("A", "feb", "3")]
    long = frame(spark, ["id", "month", "amount", "o"], [("A", "jan", "2", "1"), ("A", "jan", "3", "2"), ("A", "feb", "4", "3"), ("B", "feb", "", "4")])
    out = reshape.pivot(long, "month", "amount", ["id"], "sum", ["o"])
    assert out.columns == ["id", "jan", "feb"] and sorted(rows(out)) == [("A", "5", "4"), ("B", "", "")]


def test_projection_and_unions(spark):
    a, b = frame(spark, ["id", "name"], [("1", "x")]), frame(spark, ["id", "email"], [("2", "y")])
    assert project.union([a, b]).columns == ["id", "name", "email"] and project.union([a, b], "intersection").columns == ["id"]
    assert project.select(a, ["name", "id"]).columns == ["id", "name"] and project.select(a, order=["name"]).columns == ["name", "id"]
    for bad in ({"id": "name"}, {"x": "y"}, {"id": ""}, {"id": "z", "name": "z"}):
        with pytest.raises(project.MappingError):
            project.rename(a, bad)
    assert [project.header(" firstName-Of.X ", m) for m in ("none", "lowercase", "snake_case")] == ["firstName-Of.X", "firstname-of.x", "first_name_of_x"]


def test_joins(spark):
    left = frame(spark, ["id", "v"], [(" A ", "1"), ("a", "2"), ("", "3")])
    right = frame(spark, ["id", "v"], [("a", "9"), ("b", "8")])
    n = lambda how: joins.join(left, right, ["id"], how).count()
    assert {h: n(h) for h in joins.HOW} == {"inner": 2, "left": 3, "right": 3, "outer": 4, "full": 4, "semi": 2, "anti": 1}
    assert joins.join(left, right, ["id"]).columns == ["id", "v", "v_right"]
    d = joins.diagnostics(left, right, ["id"]).first()
    assert (d["left_missing_key"], d["left_duplicate_keys"], d["matched_keys"], d["cardinality"]) == (1, 1, 1, "one-to-many")
    assert joins.conflicts(left, right, ["id"]).count() == 2
    assert joins.output_names(["k", "v", "v_right"], ["k", "v"], ["k"]) == {"v": "v_right2"}


def test_three_way_merge(spark):
    base = frame(spark, ["id", "a", "b"], [("1", "x", "x"), ("2", "x", "x"), ("3", "x", "x"), ("4", "x", "x")])
    ours = frame(spark, ["id", "a", "b"], [("1", "o", "x"), ("2", "o", "x"), ("3", "x", "x"), ("5", "n", "n")])
    theirs = frame(spark, ["id", "a", "b"], [("1", "t", "x"), ("2", "x", "t"), ("4", "x", "x")])
    out = lambda **k: {r[0]: r[1:] for r in rows(merge.merge(base, ours, theirs, ["id"], **k))}
    assert out(resolution="ours") == {"1": ("o", "x"), "2": ("o", "x"), "5": ("n", "n")}
    assert out(resolution="theirs")["1"] == ("t", "x") and out(resolution="base")["1"] == ("x", "x")
    assert out(resolution="mark")["1"][0] == "<<<<<<< ours\no\n=======\nt\n>>>>>>> theirs" and out(resolution="ours", cell_merge=True)["2"] == ("o", "t")
    for bad in (lambda: merge.merge(base, ours, theirs, ["id"]), lambda: merge.merge(base, ours.union(ours), theirs, ["id"], "ours")):
        with pytest.raises(joins.JoinError):
            bad()


CONTRACT = {"fields": [{"name": "id", "type": "integer", "constraints": {"required": True, "unique": True}}, {"name": "name", "constraints": {"required": True}}], "primaryKey": "id"}


def test_contract(spark):
    df = frame(spark, ["id", "name", "o"], [("1", "A", "1"), ("bad", "", "2"), ("1", "B", "3")])
    found = sorted((r["o"], r["column"], r["rule"]) for r in contract.errors(df, CONTRACT, ["o"]).collect())
    assert found == [("2", "id", "type:integer"), ("2", "name", "required"), ("3", "id", "primaryKey.unique"), ("3", "id", "unique")]
    assert rows(contract.enforced(df, CONTRACT, ["o"], "quarantine")) == [("1", "A", "1")] and contract.enforced(df, CONTRACT, ["o"], "advisory").count() == 3
    for bad in (lambda: contract.enforced(df, CONTRACT, ["o"]), lambda: contract.normalized({"fields": [{"name": "a", "format": "x"}]}), lambda: contract.normalized({"fields": [], "foreignKeys": []})):
        with pytest.raises(contract.ContractError):
            bad()


def test_contract_inference(spark):
    df = frame(spark, ["id", "amount", "active", "note"], [("1", "1.5", "true", "a"), ("2", "2", "false", "")])
    by = {f["name"]: (f["type"], f["constraints"]) for f in contract.as_contract(df)["fields"]}
    assert by == {"id": ("integer", {"required": True, "unique": True}), "amount": ("number", {"required": True, "unique": True}), "active": ("boolean", {"required": True, "unique": True}), "note": ("string", {"unique": True})}


def test_profile(spark):
    df = frame(spark, ["id", "status", "amount"], [("1", "ok", "4"), ("1", "", "x"), ("2", "NULL", "1.5")])
    p = {r["column"]: r for r in profile.profile(df).collect()}
    assert not p["id"]["unique"] and p["status"]["blank_count"] == 1 and p["status"]["null_count"] == 1 and p["amount"]["numeric_max"] == 4.0
    assert rows(profile.facets(df, ["id"], 1)) == [("id", "1", 2, 1)]
    kinds = {r["column"]: r["type"] for r in profile.column_types(df).collect()}
    assert kinds == {"id": "number", "status": "text", "amount": "text"}
    assert sorted(r["row_number"] for r in profile.numbered(df, ["id", "status"]).collect()) == [1, 2, 3]


def test_repairs(spark):
    df = frame(spark, ["id", "name"], [("1", "Alice"), ("2", "Bob")])
    edit = {"row": 1, "column": "name", "expected_old": "Alice", "new_value": "Alicia"}
    assert sorted(rows(repair.repair(df, [edit], ["id"]))) == [("1", "Alicia"), ("2", "Bob")]
    for bad in ([edit | {"expected_old": "Eve"}], [edit | {"row": 9}], [edit | {"column": "x"}], [edit, edit]):
        with pytest.raises(repair.RepairError):
            repair.repair(df, bad, ["id"])
