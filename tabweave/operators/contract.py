"""Table contracts: a subset of Table Schema, checked on rows, inferred from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

TYPES = ("string", "integer", "number", "boolean", "date", "datetime")
_TOP = {"fields", "primaryKey", "missingValues", "name", "title", "description", "$schema"}
_FIELD = {"name", "type", "title", "description", "constraints"}
_CONSTRAINTS = {"required", "unique", "nullable"}


class ContractError(ValueError):
    """A contract that holds what isn't supported."""


def normalized(contract: dict) -> dict:
    """The contract with defaults filled in; raises ContractError for what is unknown."""
    if extra := set(contract) - _TOP:
        raise ContractError(f"not supported: {', '.join(sorted(extra))}")
    fields = []
    for f in contract.get("fields") or []:
        c = f.get("constraints") or {}
        if extra := (set(f) - _FIELD) | {f"constraints.{x}" for x in set(c) - _CONSTRAINTS}:
            raise ContractError(f"not supported: {', '.join(sorted(extra))}")
        if not f.get("name") or f.get("type", "string") not in TYPES:
            raise ContractError(f"a field needs a name and one of the types {', '.join(TYPES)}: {f}")
        fields.append({"name": f["name"], "type": f.get("type", "string"), "constraints": dict(c)})
    names = [f["name"] for f in fields]
    if not fields or len(set(names)) < len(names):
        raise ContractError("fields are absent or repeat a name")
    key = contract.get("primaryKey") or []
    key = [key] if isinstance(key, str) else list(key)
    if missing := [k for k in key if k not in names]:
        raise ContractError(f"key columns are no fields: {', '.join(missing)}")
    return {"fields": fields, "primaryKey": key, "missingValues": list(contract.get("missingValues", [""]))}


def fits(c: Column, kind: str) -> Column:
    tests = {
        "string": lambda: F.lit(True),
        "integer": lambda: c.rlike(r"^[-+]?\d+$"),
        "number": lambda: ~c.contains(",") & X.finite(c),
        "boolean": lambda: F.lower(c).isin("true", "false", "1", "0"),
        "date": lambda: X.iso_date(c),
        "datetime": lambda: X.iso_datetime(c),
    }
    return F.coalesce(tests[kind](), F.lit(False))


def checked(df: DataFrame, contract: dict, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """df with `errors`, an array of struct(column, rule, observed). Of equal values all but the first in order fail
    `unique`; `within` names columns (such as the file) that uniqueness is looked at within.

    The first of equal values is a grouped minimum joined back, so a frequent value isn't one task's work.
    """
    spec = normalized(contract)
    order = F.struct(*[F.col(X.quoted(c)) for c in order_by])
    cell = lambda n: X.text(df, n) if n in df.columns else F.lit("")
    missing = spec["missingValues"]
    out = df.withColumn("_order", order)
    keys = [(f"_u{i}", [f["name"]]) for i, f in enumerate(spec["fields"]) if f["constraints"].get("unique")]
    keys += [("_pk", spec["primaryKey"])] if spec["primaryKey"] else []
    for name, columns in keys:
        parts = [cell(c).alias(f"{name}_{i}") for i, c in enumerate(columns)]
        place = [F.col(X.quoted(c)).alias(f"{name}_in{i}") for i, c in enumerate(within)]
        first = df.select(*parts, *place, order.alias("_order")).groupBy(*[p for p in (f"{name}_{i}" for i in range(len(columns)))], *[f"{name}_in{i}" for i in range(len(within))]).agg(F.min("_order").alias(name))
        on = [out_c.eqNullSafe(first[f"{name}_{i}"]) for i, out_c in enumerate(cell(c) for c in columns)] + [F.col(X.quoted(c)).eqNullSafe(first[f"{name}_in{i}"]) for i, c in enumerate(within)]
        test = on[0]
        for t in on[1:]:
            test = test & t
        out = out.join(first, test, "left").drop(*[f"{name}_{i}" for i in range(len(columns))], *[f"{name}_in{i}" for i in range(len(within))])
    errors = []
    error = lambda cond, column, rule, seen: F.when(cond, F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule"), seen.alias("observed")))
    for i, f in enumerate(spec["fields"]):
        v, c = cell(f["name"]), f["constraints"]
        blank = v.isin(missing)
        if not c.get("nullable", not c.get("required", False)):
            errors.append(error(blank, f["name"], "required", v))
        errors.append(error(~blank & ~fits(v, f["type"]), f["name"], f"type:{f['type']}", v))
        if c.get("unique"):
            errors.append(error(~blank & (F.col(f"_u{i}") != F.col("_order")), f["name"], "unique", v))
    if key := spec["primaryKey"]:
        v, blank = F.concat_ws(",", *[cell(k) for k in key]), F.lit(False)
        for k in key:
            blank = blank | cell(k).isin(missing)
        errors.append(error(blank, ",".join(key), "primaryKey", v))
        errors.append(error(~blank & (F.col("_pk") != F.col("_order")), ",".join(key), "primaryKey.unique", v))
    return out.withColumn("errors", F.array_compact(F.array(*errors))).select(*[F.col(X.quoted(c)) for c in df.columns], "errors")


def errors(df: DataFrame, contract: dict, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """A row for each error: the order columns, column, rule and what was seen."""
    return checked(df, contract, order_by, within).select(*[F.col(X.quoted(c)) for c in order_by], F.explode("errors").alias("e")).select(*[F.col(X.quoted(c)) for c in order_by], "e.*")


def enforced(df: DataFrame, contract: dict, order_by: Sequence[str], mode: str = "strict") -> DataFrame:
    """strict: raises if a row fails; advisory: all rows; quarantine: the rows that don't fail."""
    found = checked(df, contract, order_by)
    if mode == "strict":
        n = found.where(F.size("errors") > 0).count()
        if n:
            raise ContractError(f"{n} rows break the contract")
    return (found.where(F.size("errors") == 0) if mode == "quarantine" else found).drop("errors")


def inferred(df: DataFrame) -> DataFrame:
    """A row for each column: name, type, required, unique."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), X.text(df, c).alias("v")) for c in df.columns])
    v = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("name", "v").agg(F.count("*").alias("n"))
    blank = (X.strip(F.col("v")) == "") | F.col("v").isin("null", "NULL")
    every = lambda test: F.coalesce(F.bool_and(F.when(~blank, test)), F.lit(False))
    out = v.groupBy("name").agg(
        every(fits(F.col("v"), "integer")).alias("_i"), every(fits(F.col("v"), "number")).alias("_n"), every(F.lower("v").isin("true", "false")).alias("_b"),
        (~F.bool_or(blank)).alias("required"), F.coalesce(F.bool_and(F.when(~blank, F.col("n") == 1)), F.lit(False)).alias("unique"),
    )
    kind = F.when(F.col("_i"), "integer").when(F.col("_n"), "number").when(F.col("_b"), "boolean").otherwise("string")
    return out.select("name", kind.alias("type"), "required", "unique")


def as_contract(df: DataFrame) -> dict:
    """The inferred contract as a document."""
    found = {r["name"]: r for r in inferred(df).collect()}
    fields = [{"name": c, "type": found[c]["type"] if c in found else "string", "constraints": {k: True for k in ("required", "unique") if c in found and found[c][k]}} for c in df.columns]
    return {"fields": fields, "missingValues": [""]}

