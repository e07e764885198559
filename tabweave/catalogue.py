"""The registered queries of the tabular engine, each with the SQL it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contract, dedupe, filters, joins, merge, profile, project, ranges, repair, reshape, sort, transforms
from .plans import sql_lane
from .session import shared_folder
from .sources import scan, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The given tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- the flagship: filter, semi join, dedupe, sort ------------------------------------------------------------------


@query(
    "pipeline_flagship",
    """SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders
         WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND o_totalprice BETWEEN 1000 AND 400000
           AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) WHERE n = 1 ORDER BY place LIMIT 1000""",
)
def _(t):
    o = filters.apply(t.orders, [("o_orderdate", "between", "1995-01-01..1997-12-31"), ("o_totalprice", "between", "1000..400000")])
    good = filters.apply(t.customer, [("c_acctbal", "greater_than", "0")]).select(F.col("c_custkey").alias("o_custkey"))
    one = dedupe.distinct(joins.join(o.select("o_custkey", "o_orderkey", "o_totalprice"), good, ["o_custkey"], "semi"), ["o_custkey"], order_by=["o_orderkey"])
    top = sort.sort(one, [("o_totalprice", False)], ties=["o_orderkey"]).limit(1000)
    return top.select("o_orderkey", "o_custkey", "o_totalprice", F.row_number().over(_by(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


def _by(*order):
    from pyspark.sql.window import Window

    return Window.orderBy(*order)


# --- filters --------------------------------------------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE "
_PARTS = "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE "
_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE "
_NOTES = "SELECT * FROM (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '  ' ELSE s_name END AS note FROM supplier) WHERE "


def _orders(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


def _parts(t):
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type")


def _lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _notes(t):
    return t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") < 0, "  ").otherwise(F.col("s_name")).alias("note"))


for _name, _source, _sql, _rules, _where in [
    ("filter_equals", lambda t: t.customer.select("c_custkey", "c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer WHERE ", [("c_mktsegment", "equals", "furniture")], "lower(c_mktsegment) = 'furniture'"),
    ("filter_not_equals", _orders, _ORDERS, [("o_orderstatus", "not_equals", "f")], "lower(o_orderstatus) <> 'f'"),
    ("filter_contains", _parts, _PARTS, [("p_name", "contains", "WID")], "contains(lower(p_name), 'wid')"),
    ("filter_not_contains", _parts, _PARTS, [("p_name", "not_contains", "WID")], "NOT contains(lower(p_name), 'wid')"),
    ("filter_starts_with", _parts, _PARTS, [("p_type", "starts_with", "eco")], "starts_with(lower(p_type), 'eco')"),
    ("filter_ends_with", _parts, _PARTS, [("p_name", "ends_with", "GET")], "ends_with(lower(p_name), 'get')"),
    ("filter_is_empty", _notes, _NOTES, [("note", "is_empty", "")], "trim(note) = ''"),
    ("filter_is_not_empty", _notes, _NOTES, [("note", "is_not_empty", "")], "trim(note) <> ''"),
    ("filter_gt", _lines, _LINES, [("l_quantity", "greater_than", "45")], "l_quantity > 45"),
    ("filter_lt", _lines, _LINES, [("l_quantity", "less_than", "3")], "l_quantity < 3"),
    ("filter_gte", _lines, _LINES, [("l_quantity", "greater_than_or_equal", "1e1")], "l_quantity >= 10"),
    ("filter_lte", _lines, _LINES, [("l_quantity", "less_than_or_equal", "4")], "l_quantity <= 4"),
    ("filter_between_number", _orders, _ORDERS, [("o_totalprice", "between", "1,000..50,000")], "o_totalprice BETWEEN 1000 AND 50000"),
    ("filter_in_list", _orders, _ORDERS, [("o_orderpriority", "in_list", "1-URGENT, 2-high")], "lower(o_orderpriority) IN ('1-urgent', '2-high')"),
    ("filter_not_in_list", _orders, _ORDERS, [("o_orderpriority", "not_in_list", "1-URGENT, 2-high")], "lower(o_orderpriority) NOT IN ('1-urgent', '2-high')"),
    ("filter_regex", _parts, _PARTS, [("p_brand", "regex", "brand#1[0-9]")], "regexp_matches(p_brand, 'brand#1[0-9]', 'i')"),
    ("filter_and", _orders, _ORDERS, [("o_orderstatus", "equals", "o"), ("o_totalprice", "greater_than", "100000")], "lower(o_orderstatus) = 'o' AND o_totalprice > 100000"),
]:
    query(_name, _sql + _where)(lambda t, s=_source, r=_rules: filters.apply(s(t), r))

query("filter_or", _ORDERS + "lower(o_orderstatus) = 'f' OR o_totalprice > 200000")(lambda t: filters.apply(_orders(t), [("o_orderstatus", "equals", "F"), ("o_totalprice", "greater_than", "200000")], "or"))
query("filter_between_date", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")(
    lambda t: filters.apply(t.orders.select("o_orderkey", "o_orderdate"), [("o_orderdate", "between", "1996-01-01|1996-12-31")])
)
query("filter_fuzzy")(lambda t: filters.apply(_parts(t), [("p_name", "fuzzy", "small widget|80")]))
query("facet_filter", _PARTS + "p_type = (SELECT min(p_type) FROM part)")(lambda t: _parts(t).join(F.broadcast(t.part.agg(F.min("p_type").alias("p_type"))), "p_type").select("p_partkey", "p_name", "p_brand", "p_type"))

# --- columns, unions, order -----------------------------------------------------------------------------------------

query("project_select", "SELECT c_custkey, c_name, c_acctbal FROM customer")(lambda t: project.select(t.customer, ["c_acctbal", "c_custkey", "c_name", "absent"]))
query("project_exclude", "SELECT c_custkey, c_name, c_nationkey FROM customer")(lambda t: project.select(t.customer, exclude=["c_acctbal", "c_mktsegment"]))
query("project_rename", "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")(lambda t: project.rename(t.customer, {"c_custkey": "id", "c_name": "name"}))
query("header_snake_case", "SELECT c_custkey AS customer_key, c_name AS full_name FROM customer")(lambda t: project.normalized_headers(t.customer.select(F.col("c_custkey").alias("CustomerKey"), F.col("c_name").alias("Full-Name")), "snake_case"))


def _people(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return [c, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))]


_C, _S = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance"
query("union_by_name", f"{_C}, c_mktsegment AS segment FROM customer UNION ALL BY NAME {_S}, s_nationkey AS nation FROM supplier")(lambda t: project.union(_people(t)))
query("union_intersection", f"{_C} FROM customer UNION ALL {_S} FROM supplier")(lambda t: project.union(_people(t), "intersection"))
query("union_first_file", f"{_C}, c_mktsegment AS segment FROM customer UNION ALL {_S}, NULL FROM supplier")(lambda t: project.union(_people(t), "first_file"))
query("union_distinct", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")(
    lambda t: dedupe.distinct(project.union([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))]), ["k"], order_by=["k"])
)
query("source_column", "SELECT r_regionkey AS k, r_name AS name, 'region' AS source FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")(
    lambda t: project.union([t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("region").alias("source")), t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit("nation").alias("source"))])
)
query("sort_multi", "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey) AS place FROM customer")(
    lambda t: profile.numbered(*sort.projected(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), [("c_mktsegment", True), ("c_acctbal", False)], ["c_custkey"]), "place").select("c_custkey", "place")
)
_MIXED = "CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR WHEN p_size % 3 = 1 THEN '2020-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') ELSE p_brand END"
query(
    "sort_mixed_cells",
    f"SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 2 END, CASE WHEN p_size % 3 = 0 THEN p_size END NULLS FIRST, "
    f"CASE WHEN p_size % 3 = 1 THEN {_MIXED} END NULLS FIRST, CASE WHEN p_size % 3 = 2 THEN lower(p_brand) END NULLS FIRST, p_partkey) AS place FROM part",
)(lambda t: (lambda p: profile.numbered(*sort.projected(p, [("cell", True)], ["p_partkey"]), "place").select("p_partkey", "place"))(
    t.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("2020-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))).otherwise(F.col("p_brand")).alias("cell"))
))
query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda t: sort.sort(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", False)], ties=["o_orderkey"]).limit(50))

# --- transforms -----------------------------------------------------------------------------------------------------


def _part_text(t):
    return t.part.select(F.col("p_partkey").cast("string").alias("k"), "p_name", "p_type", "p_brand")


query("transform_case", "SELECT p_partkey::VARCHAR AS k, upper(p_name) AS p_name, lower(p_type) AS p_type, p_brand FROM part")(lambda t: transforms.apply(_part_text(t), [("p_name", "upper"), ("p_type", "lower")]))
query("transform_title", "SELECT s_suppkey::VARCHAR AS k, 'O''Neil Abc1Def ' || s_suppkey::VARCHAR AS v FROM supplier")(
    lambda t: transforms.apply(t.supplier.select(F.col("s_suppkey").cast("string").alias("k"), F.concat(F.lit("o'neil abc1def "), F.col("s_suppkey").cast("string")).alias("v")), [("v", "title")])
)
query("transform_trim", "SELECT s_suppkey::VARCHAR AS k, s_name AS v FROM supplier")(lambda t: transforms.apply(t.supplier.select(F.col("s_suppkey").cast("string").alias("k"), F.concat(F.lit("\t "), F.col("s_name"), F.lit(" \n")).alias("v")), [("v", "trim")]))
query("transform_replace", "SELECT p_partkey::VARCHAR AS k, replace(p_name, 'e', '3') AS p_name, p_type, p_brand FROM part")(lambda t: transforms.apply(_part_text(t), [("p_name", "replace", "e", "3")]))
query("transform_regex_replace", r"SELECT p_partkey::VARCHAR AS k, p_name, p_type, regexp_replace(p_brand, '([A-Za-z]+)#(\d)', '\2-\1', 'g') AS p_brand FROM part")(
    lambda t: transforms.apply(_part_text(t), [("p_brand", "regex_replace", r"([A-Za-z]+)#(\d)", r"\2-\1")])
)
query("transform_split", "SELECT p_partkey::VARCHAR AS k, p_brand, split_part(p_brand, '#', 1) AS p_brand_1, split_part(p_brand, '#', 2) AS p_brand_2 FROM part")(lambda t: transforms.apply(_part_text(t).select("k", "p_brand"), [("p_brand", "split", "#", 2)]))
query("transform_merge", "SELECT c_custkey::VARCHAR AS k, c_name, c_mktsegment, c_name || ' / ' || c_mktsegment AS label FROM customer")(
    lambda t: transforms.apply(t.customer.select(F.col("c_custkey").cast("string").alias("k"), "c_name", "c_mktsegment"), [("label", "merge", " / ", "c_name", "c_mktsegment")])
)
query("transform_compute", "SELECT l_orderkey::VARCHAR AS l_orderkey, l_quantity::BIGINT::VARCHAR AS q, (l_quantity::BIGINT * 3 + l_linenumber)::VARCHAR AS total FROM lineitem")(
    lambda t: transforms.apply(t.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), "l_linenumber"), [("total", "compute", "{q} * 3 + {l_linenumber}")]).drop("l_linenumber")
)
query("transform_rename_missing", "SELECT c_custkey::VARCHAR AS id, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'none') AS c_mktsegment FROM customer")(
    lambda t: transforms.apply(t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("c_mktsegment")), renames={"c_custkey": "id"}, empty_value="none")
)
query(
    "redact_sensitive",
    """SELECT c_custkey::VARCHAR AS k, '[REDACTED]' AS email, CASE WHEN c_custkey % 3 = 2 THEN c_name ELSE '[REDACTED]' END AS memo FROM customer""",
)(lambda t: transforms.redact(t.customer.select(
    F.col("c_custkey").cast("string").alias("k"), F.lit("x").alias("email"),
    F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("123-45-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com"))).otherwise(F.col("c_name")).alias("memo"),
)))

# --- reshape --------------------------------------------------------------------------------------------------------

query("unpivot", "SELECT l_orderkey, l_partkey, name, value FROM (SELECT l_orderkey, l_partkey, l_tax, l_discount FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR name IN (l_tax, l_discount))")(
    lambda t: reshape.unpivot(t.lineitem.select("l_orderkey", "l_partkey", "l_tax", "l_discount"), ["l_orderkey", "l_partkey"], ["l_tax", "l_discount"], "name", "value")
)


def _status(t):
    return t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_orderpriority").alias("priority"))


def _cases(expression: str) -> str:
    return ", ".join(f"{expression.format(s=s)} AS \"{s}\"" for s in ("F", "O", "P"))


query("pivot_sum", f"SELECT o_custkey, {_cases('sum(o_orderkey) FILTER (o_orderstatus = {s!r})::BIGINT')} FROM orders GROUP BY 1")(
    lambda t: reshape.pivot(_status(t), "o_orderstatus", "o_orderkey", ["o_custkey"], "sum", ["o_orderkey"], values=["F", "O", "P"])
)
query("pivot_min", f"SELECT o_custkey, {_cases('min(o_orderkey) FILTER (o_orderstatus = {s!r})')} FROM orders GROUP BY 1")(
    lambda t: reshape.pivot(_status(t), "o_orderstatus", "o_orderkey", ["o_custkey"], "min", ["o_orderkey"], values=["F", "O", "P"])
)
query("pivot_max", f"SELECT o_custkey, {_cases('max(o_orderkey) FILTER (o_orderstatus = {s!r})')} FROM orders GROUP BY 1")(
    lambda t: reshape.pivot(_status(t), "o_orderstatus", "o_orderkey", ["o_custkey"], "max", ["o_orderkey"])
)
query("pivot_first", f"SELECT o_custkey, {_cases('coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = {s!r}), ' + chr(39) * 2 + ')')} FROM orders GROUP BY 1")(
    lambda t: reshape.pivot(_status(t), "o_orderstatus", "priority", ["o_custkey"], "first", ["o_orderkey"])
)
query("pivot_concat", f"SELECT o_custkey, {_cases('coalesce(string_agg(o_orderkey::VARCHAR, ' + chr(39) + '; ' + chr(39) + ' ORDER BY o_orderkey) FILTER (o_orderstatus = {s!r}), ' + chr(39) * 2 + ')')} FROM orders GROUP BY 1")(
    lambda t: reshape.pivot(_status(t).withColumn("text", F.col("o_orderkey").cast("string")), "o_orderstatus", "text", ["o_custkey"], "concat", ["o_orderkey"])
)

# --- duplicates -----------------------------------------------------------------------------------------------------


def _dedupe_orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


for _keep, _way in (("first", ""), ("last", " DESC")):
    query(f"dedupe_{_keep}", f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey{_way}) AS n FROM orders) WHERE n = 1")(
        lambda t, k=_keep: dedupe.distinct(_dedupe_orders(t), ["o_custkey"], k, ["o_orderkey"])
    )
for _mode in ("sum", "max", "min"):
    query(f"dedupe_aggregate_{_mode}", f"SELECT l_orderkey, {_mode}(l_linenumber){'::BIGINT' if _mode == 'sum' else ''} AS l_linenumber, {_mode}(l_partkey){'::BIGINT' if _mode == 'sum' else ''} AS l_partkey FROM lineitem GROUP BY 1")(
        lambda t, m=_mode: dedupe.aggregate(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], m, ["l_linenumber", "l_partkey"])
    )
query("dedupe_aggregate_concat", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '; ' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")(
    lambda t: dedupe.aggregate(t.orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("keys"), "o_orderkey"), ["o_custkey"], "concat", ["o_orderkey"]).select("o_custkey", "keys")
)
query(
    "dedupe_aggregate_text_sum",
    "SELECT o_custkey, CASE WHEN arg_min(v, o_orderkey) = 'n/a' THEN 'n/a' ELSE sum(CASE WHEN v <> 'n/a' THEN v::BIGINT END)::BIGINT::VARCHAR END AS v FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE (o_orderkey % 100)::VARCHAR END AS v FROM orders) GROUP BY 1",
)(lambda t: dedupe.aggregate(t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("v")), ["o_custkey"], "sum", ["o_orderkey"]).select("o_custkey", "v"))
query("dedupe_preview", "SELECT user_id, event_type, count(*) AS n_rows, min(event_id) AS kept FROM events GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda t: dedupe.preview(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]).withColumn("kept", F.col("kept.event_id"))
)
query("fuzzy_dedupe")(lambda t: dedupe.fuzzy(_parts(t).select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name"], 90, ["p_partkey"]))

# --- joins and merge ------------------------------------------------------------------------------------------------


def _left(t):
    return t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey")


def _right(t):
    return t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_name")


_L, _R = "(SELECT o_custkey AS k, o_orderkey FROM orders)", "(SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 3 <> 0)"
for _how, _sql in {
    "inner": f"SELECT l.k, o_orderkey, c_name FROM {_L} l JOIN {_R} r ON l.k = r.k",
    "left": f"SELECT l.k, o_orderkey, c_name FROM {_L} l LEFT JOIN {_R} r ON l.k = r.k",
    "right": f"SELECT r.k, o_orderkey, c_name FROM {_L} l RIGHT JOIN {_R} r ON l.k = r.k",
    "full": f"SELECT coalesce(l.k, r.k) AS k, o_orderkey, c_name FROM {_L} l FULL JOIN {_R} r ON l.k = r.k",
    "semi": f"SELECT k, o_orderkey FROM {_L} l WHERE EXISTS (SELECT 1 FROM {_R} r WHERE l.k = r.k)",
    "anti": f"SELECT k, o_orderkey FROM {_L} l WHERE NOT EXISTS (SELECT 1 FROM {_R} r WHERE l.k = r.k)",
}.items():
    query(f"join_{_how}", _sql)(lambda t, h=_how: joins.join(_left(t), _right(t), ["k"], h))
query("join_normalized_text", "SELECT ' ' || upper(n_name) AS name, n_nationkey, r.s_suppkey FROM nation JOIN (SELECT n_name AS name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) r ON n_name = r.name")(
    lambda t: joins.join(t.nation.select(F.concat(F.lit(" "), F.upper("n_name")).alias("name"), "n_nationkey"), t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "s_suppkey"), ["name"])
)
query("join_collision_suffix", "SELECT n_regionkey AS k, n_name AS name, r_name AS name_right FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda t: joins.join(t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), ["k"])
)
query("join_chain", "SELECT c_nationkey AS k, c_custkey, n_name, s_suppkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = c_nationkey")(
    lambda t: joins.chain([t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey"), t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey")], ["k"], multiplied=True)
)
query("join_chain_customers", "SELECT c_custkey, c_nationkey AS k, n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda t: joins.join(
        joins.chain([t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey"), t.nation.select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")], ["k"]), t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"]
    )
)
query("join_collision_suffix_orders", "SELECT o_custkey AS k, o_orderkey AS id, c_nationkey AS id_right FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda t: joins.join(t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id")), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("id")), ["k"])
)
query(
    "join_diagnostics",
    f"""WITH l AS (SELECT k, count(*) AS n FROM {_L} GROUP BY k), r AS (SELECT k, count(*) AS n FROM {_R} GROUP BY k), b AS (SELECT l.n AS nl, r.n AS nr FROM l FULL JOIN r ON l.k = r.k)
       SELECT sum(nl)::BIGINT AS left_rows, 0::BIGINT AS left_missing_key, count(*) FILTER (nl > 1) AS left_duplicate_keys, sum(nl) FILTER (nl IS NOT NULL AND nr IS NOT NULL)::BIGINT AS left_matched_rows,
         sum(nr)::BIGINT AS right_rows, 0::BIGINT AS right_missing_key, count(*) FILTER (nr > 1) AS right_duplicate_keys, sum(nr) FILTER (nl IS NOT NULL AND nr IS NOT NULL)::BIGINT AS right_matched_rows,
         count(*) FILTER (nl IS NOT NULL AND nr IS NOT NULL) AS matched_keys, 'one-to-many' AS cardinality FROM b""",
)(lambda t: joins.diagnostics(_left(t), _right(t), ["k"]))
query("join_conflicts", "SELECT c_custkey AS k, 'c_mktsegment' AS \"column\", c_mktsegment AS left_value, lower(c_mktsegment) AS right_value FROM customer WHERE c_custkey % 5 = 0 AND c_mktsegment <> lower(c_mktsegment)")(
    lambda t: joins.conflicts(t.customer.select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment"), t.customer.select(F.col("c_custkey").alias("k"), "c_name", F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")), ["k"])
)


def _edits(t):
    base = t.customer.select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), "c_custkey")
    edit = lambda when, v: F.when(when, F.concat(F.col("seg"), F.lit(v))).otherwise(F.col("seg")).alias("seg")
    ours = base.where("c_custkey % 11 <> 0").select("k", "name", edit(F.col("c_custkey") % 4 == 0, "-o"))
    theirs = base.where("c_custkey % 13 <> 0").select("k", "name", edit(F.col("c_custkey") % 6 == 0, "-t"))
    return base.select("k", "name", "seg"), ours, theirs


_MERGE = """WITH b AS (SELECT c_custkey::VARCHAR AS k, c_name AS name, c_mktsegment AS seg, c_custkey AS n FROM customer),
  m AS (SELECT *, n % 11 = 0 AS od, n % 13 = 0 AS td, n % 4 = 0 AS oe, n % 6 = 0 AS te FROM b),
  s AS (SELECT *, CASE WHEN oe THEN seg || '-o' ELSE seg END AS os, CASE WHEN te THEN seg || '-t' ELSE seg END AS ts FROM m)
SELECT k,
  CASE WHEN (od AND te AND NOT td) OR (td AND oe AND NOT od) THEN name ELSE name END AS name,
  CASE WHEN od AND te THEN {delete_ours} WHEN td AND oe THEN {delete_theirs} WHEN oe AND te THEN {both} WHEN oe THEN os WHEN te THEN ts ELSE seg END AS seg
FROM s WHERE NOT (od AND td) AND NOT (od AND NOT te) AND NOT (td AND NOT oe)"""
for _res, _both, _do, _dt in [
    ("ours", "os", "''", "os"),
    ("theirs", "ts", "ts", "''"),
    ("base", "seg", "seg", "seg"),
    ("mark", *[f"'<<<<<<< ours' || chr(10) || {o} || chr(10) || '=======' || chr(10) || {x} || chr(10) || '>>>>>>> theirs'" for o, x in (("os", "ts"), ("''", "ts"), ("os", "''"))]),
]:
    query(f"three_way_{_res}", _MERGE.format(both=_both, delete_ours=_do, delete_theirs=_dt))(lambda t, r=_res: merge.merge(*_edits(t), ["k"], r, check=False))
query("three_way_conflicts", "SELECT c_custkey::VARCHAR AS k, 'seg' AS \"column\", c_mktsegment AS base, c_mktsegment || '-o' AS ours, c_mktsegment || '-t' AS theirs FROM customer WHERE c_custkey % 12 = 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0")(
    lambda t: merge.conflicts(*_edits(t), ["k"]).where("`column` = 'seg' and ours <> '' and theirs <> ''")
)

# --- ranges ---------------------------------------------------------------------------------------------------------


def _spans(t):
    days = F.make_dt_interval((F.col("o_orderkey") % 40).cast("int"))
    return t.orders.select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.col("o_orderdate").alias("opened"), (F.col("o_orderdate") + days).alias("closed"))


def _moments(t):
    # events of 2024 as of 25 years before, among the orders
    return t.events.select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 25 YEAR")).alias("moment"))


_RANGES = "(SELECT event_id, user_id, ts - INTERVAL 25 YEAR AS moment FROM events) e {} JOIN (SELECT o_orderkey, o_custkey % 150 AS user_id, o_orderdate AS opened, o_orderdate + to_days((o_orderkey % 40)::INT) AS closed FROM orders) o ON e.user_id = o.user_id AND moment BETWEEN opened AND closed"
query("interval_join", "SELECT event_id, o_orderkey FROM " + _RANGES.format(""))(lambda t: ranges.interval_join(_moments(t), _spans(t), "moment", "opened", "closed", ["user_id"]).select("event_id", "o_orderkey"))
query("interval_join_left", "SELECT event_id, o_orderkey FROM " + _RANGES.format("LEFT"))(lambda t: ranges.interval_join(_moments(t), _spans(t), "moment", "opened", "closed", ["user_id"], "left").select("event_id", "o_orderkey"))

# --- files: written by all tasks, read again ------------------------------------------------------------------------


def _again(df: DataFrame, kind: str) -> DataFrame:
    """df's columns as texts, from a folder that it was written to in the shared folder."""
    uri = f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"
    sinks.write_folder(df, uri, kind)
    found = scan.expand([uri], spark=df.sparkSession, parts=True)
    return scan.read_all(df.sparkSession, found, trim=False)[0].drop(*scan.HIDDEN)


query("files_delimited", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents")(lambda t: _again(t.documents.select("doc_id", "text", "lang"), "csv"))
query("files_json_lines", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")(lambda t: _again(t.conversations.select("conv_id", "turn", "role", "text"), "jsonl"))
query("files_parquet", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")(lambda t: _again(t.part.select("p_partkey", "p_name", "p_size"), "parquet"))

# --- set operations -------------------------------------------------------------------------------------------------

query("set_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0")(lambda t: t.supplier.select(F.col("s_nationkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select("c_nationkey")))
query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")(lambda t: t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_totalprice > 300000").select("o_custkey")))
query("set_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")(lambda t: t.orders.select(F.col("o_custkey").alias("k")).exceptAll(t.customer.select("c_custkey")))

# --- profile, contracts, repairs ------------------------------------------------------------------------------------

query(
    "profile_columns",
    """SELECT 'o_orderstatus' AS "column", count(*) AS row_count, count(*) AS non_empty_count, 0::BIGINT AS blank_count, 0::BIGINT AS null_count, count(DISTINCT o_orderstatus) AS distinct_count,
         count(*) - count(DISTINCT o_orderstatus) AS duplicate_count, false AS "unique", 'string' AS type, 1.0::DOUBLE AS confidence, 0::BIGINT AS numeric_count, NULL::DOUBLE AS numeric_min, NULL::DOUBLE AS numeric_max, NULL::DOUBLE AS numeric_mean FROM orders
       UNION ALL SELECT 'o_orderkey', count(*), count(*), 0, 0, count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_orderkey), true, 'integer', 1.0, count(*), min(o_orderkey)::DOUBLE, max(o_orderkey)::DOUBLE, sum(o_orderkey)::DOUBLE / count(*) FROM orders""",
)(lambda t: profile.profile(t.orders.select("o_orderstatus", "o_orderkey")))
query(
    "profile_bounded",
    """SELECT c AS "column", n AS row_count, least(d, 1000) AS distinct_count, d <= 1000 AS distinct_exact, type FROM (
         SELECT 'o_orderpriority' AS c, count(*) AS n, count(DISTINCT o_orderpriority) AS d, 'string' AS type FROM orders
         UNION ALL SELECT 'o_orderkey', count(*), count(DISTINCT o_orderkey), 'integer' FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), 'string' FROM orders)""",
)(lambda t: profile.bounded(t.orders, ["o_orderpriority", "o_orderkey", "o_orderstatus"], 1000).select("column", "row_count", "distinct_count", "distinct_exact", "type"))
query(
    "profile_facets",
    """SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS rank FROM (
         SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2)
       QUALIFY rank <= 3""",
)(lambda t: profile.facets(t.orders, ["o_orderpriority", "o_orderstatus"], 3))
query(
    "column_types",
    """SELECT 'event_type' AS "column", 0::BIGINT AS n_empty, 0::BIGINT AS n_boolean, 0::BIGINT AS n_number, 0::BIGINT AS n_datetime, count(*) AS n_text, 'text' AS type FROM events
       UNION ALL SELECT 'user_id', 0, 0, count(*), 0, 0, 'number' FROM events UNION ALL SELECT 'ts', 0, 0, 0, count(*), 0, 'datetime' FROM events""",
)(lambda t: profile.column_types(t.events, ["event_type", "user_id", "ts"]))
query("first_samples", "SELECT \"column\", value, rank FROM (SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey))::INT AS rank FROM orders GROUP BY 2) WHERE rank <= 2")(
    lambda t: profile.samples(t.orders, ["o_orderpriority"], ["o_orderkey"], 2)
)
_CONTRACT = {
    "fields": [
        {"name": "o_orderkey", "type": "integer", "constraints": {"required": True, "unique": True}},
        {"name": "o_custkey", "type": "integer", "constraints": {"unique": True}},
        {"name": "o_orderpriority", "type": "integer"},
        {"name": "note", "constraints": {"required": True}},
    ],
    "primaryKey": ["o_orderkey"],
}
query(
    "contract_errors",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'x' END AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
       SELECT o_orderkey, 'o_custkey' AS "column", 'unique' AS rule, o_custkey::VARCHAR AS observed FROM o WHERE n > 1
       UNION ALL SELECT o_orderkey, 'o_orderpriority', 'type:integer', o_orderpriority FROM o WHERE o_orderpriority <> ''
       UNION ALL SELECT o_orderkey, 'note', 'required', '' FROM o WHERE note = ''""",
)(lambda t: contract.errors(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "").otherwise("x").alias("note")), _CONTRACT, ["o_orderkey"]))
query("contract_quarantine", "SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")(
    lambda t: contract.enforced(t.orders.select("o_orderkey", "o_custkey"), {"fields": _CONTRACT["fields"][:2]}, ["o_orderkey"], "quarantine")
)
query("infer_contract", "SELECT 'p_partkey' AS name, 'integer' AS type, true AS required, count(*) = count(DISTINCT p_partkey) AS \"unique\" FROM part UNION ALL SELECT 'p_retailprice', 'number', true, count(*) = count(DISTINCT p_retailprice) FROM part UNION ALL SELECT 'p_type', 'string', true, count(*) = count(DISTINCT p_type) FROM part")(
    lambda t: contract.inferred(t.part.select("p_partkey", "p_retailprice", "p_type"))
)
query("row_inspection", "SELECT c_custkey, c_name, row_number FROM (SELECT *, row_number() OVER (ORDER BY c_name, c_custkey) AS row_number FROM customer) WHERE row_number = 42")(
    lambda t: profile.inspect_row(t.customer.select("c_custkey", "c_name"), 42, ["c_name", "c_custkey"])
)
query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_number FROM orders")(lambda t: profile.numbered(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]).drop("o_custkey"))
query("repairs", "SELECT r_regionkey, CASE WHEN r_regionkey = (SELECT min(r_regionkey) FROM region) THEN 'repaired' ELSE r_name END AS r_name FROM region")(
    lambda t: repair.repair(t.region, [{"row": 1, "column": "r_name", "expected_old": "AFRICA", "new_value": "repaired"}], ["r_regionkey"])
)
query("preview_rows", "SELECT least(100, count(*))::BIGINT AS n FROM events")(lambda t: sort.preview(t.events).agg(F.count("*").alias("n")))

# --- the SQL lane ---------------------------------------------------------------------------------------------------


def _sql(name: str, tables: list[str], text: str, oracle: str | None = None) -> None:
    def run(t: Tables) -> DataFrame:
        return sql_lane.query([getattr(t, n) for n in tables], text, as_text=False)[0]

    expected = oracle or text
    for i, n in enumerate(tables):
        expected = expected.replace(f"input_{i}", n)
    query(name, expected)(run)


_sql("sql_window", ["orders"], "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM input_0")
_sql("sql_grouping_sets", ["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM input_0 GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("sql_cube", ["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM input_0 GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_rollup", ["lineitem"], "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS q FROM input_0 GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_join_using", ["orders", "customer"], "SELECT c_mktsegment, count(*) AS n FROM input_0 JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM input_1) c USING (o_custkey) GROUP BY c_mktsegment")
_sql("sql_recursive_cte", ["nation"], "WITH RECURSIVE up(n, top) AS (SELECT min(n_nationkey), max(n_nationkey) FROM input_0 UNION ALL SELECT n + 1, top FROM up WHERE n < top) SELECT n, n_name FROM up JOIN input_0 ON n = n_nationkey")
_sql("sql_pivot", ["orders"], "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM input_0) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
_sql("sql_lateral", ["orders"], "SELECT o_orderkey, x FROM input_0 LATERAL VIEW explode(array(o_orderkey, o_custkey)) AS x", "SELECT o_orderkey, unnest([o_orderkey, o_custkey]) AS x FROM orders")
_sql("sql_json", ["events"], "SELECT event_id, length(props) AS n, to_json(map_from_arrays(array('k'), array(event_type))) AS j FROM input_0", "SELECT event_id, length(props) AS n, '{\"k\":\"' || event_type || '\"}' AS j FROM events")
_sql("sql_string_agg", ["nation"], "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM input_0 GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
_sql("sql_distinct_aggregates", ["lineitem"], "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open FROM input_0 GROUP BY l_returnflag")
_sql("sql_set_operations", ["customer", "supplier"], "SELECT c_nationkey AS k FROM input_0 UNION SELECT s_nationkey FROM input_1 EXCEPT SELECT 0")
query(
    "asof_rewrite",
    """SELECT a.event_id, b.event_id AS previous FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)(lambda t: _asof(t.events))


def _asof(events: DataFrame) -> DataFrame:
    """The user's last purchase at or before each event, as one window instead of a join."""
    from pyspark.sql.window import Window

    mark = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    last = F.max(mark).over(Window.partitionBy("user_id").orderBy("ts"))
    return events.select("event_id", last["event_id"].alias("previous"))
