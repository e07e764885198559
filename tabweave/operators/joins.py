"""Keyed joins of tables: normalised keys, blank keys never match, colliding names get a suffix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain as chained
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}


#: Rows up to which the right side of a join that multiplies rows is broadcast.
BROADCAST_ROWS = 200_000


class JoinError(ValueError):
    """A join or merge that its policy forbids."""


def key_parts(df: DataFrame, keys: Sequence[str], form: str = "trim-casefold") -> list[Column]:
    """Comparable key parts, null where blank. Keys of whole-number columns stay numbers."""
    out = []
    for k in keys:
        if k not in df.columns:
            raise JoinError(f"key column {k} is absent")
        if isinstance(df.schema[k].dataType, T.IntegralType):
            out.append(F.col(X.quoted(k)).cast("long"))
        else:
            cell = X.text(df, k)
            out.append(F.when(X.strip(cell) != "", X.KEY_FORMS[form](cell)))
    return out


def _keyed(df: DataFrame, keys: Sequence[str], form: str, side: str) -> DataFrame:
    return df.select(F.struct(*[F.col(X.quoted(c)) for c in df.columns]).alias(side), *[p.alias(f"{side}{i}") for i, p in enumerate(key_parts(df, keys, form))])


def output_names(left: Sequence[str], right: Sequence[str], keys: Sequence[str], suffix: str = "_right") -> dict[str, str]:
    """Output name of each right column but the keys: its own, with the suffix, or with the suffix and a number, whichever is free first."""
    names: dict[str, str] = {}
    for c in (c for c in right if c not in keys):
        candidates = chained([c, c + suffix], (f"{c}{suffix}{n}" for n in count(2)))
        names[c] = next(x for x in candidates if x not in left and x not in names.values())
    return names


def _matched(l: DataFrame, r: DataFrame, keys: Sequence[str]) -> Column:
    """All parts equal; a blank part matches nothing."""
    same = lambda i: (l[f"l{i}"] == r[f"r{i}"]) if l.schema[f"l{i}"].dataType == r.schema[f"r{i}"].dataType else (l[f"l{i}"].cast("string") == r[f"r{i}"].cast("string"))
    return reduce(lambda a, b: a & b, [same(i) for i in range(len(keys))])


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", form: str = "trim-casefold", suffix: str = "_right") -> DataFrame:
    """Rows of both sides that agree on the keys; key cells come from the left, or from the right where there is no left row."""
    if how not in HOW:
        raise JoinError(f"unknown join type: {how}")
    l, r = _keyed(left, keys, form, "l"), _keyed(right, keys, form, "r")
    met = l.join(r, _matched(l, r, keys), HOW[how])
    if how in ("semi", "anti"):
        return met.select("l.*")
    names = output_names(left.columns, right.columns, keys, suffix)
    own = [F.coalesce(F.col(f"l.{X.quoted(c)}"), F.col(f"r.{X.quoted(c)}")).alias(c) if c in keys and how in ("right", "outer", "full") else F.col(f"l.{X.quoted(c)}").alias(c) for c in left.columns]
    return met.select(*own, *[F.col(f"r.{X.quoted(c)}").alias(n) for c, n in names.items()])


def chain(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner", multiplied: bool = False, **options) -> DataFrame:
    """The tables joined one after the other, from the left. multiplied: rows may meet many of the next table (see join_many)."""
    return reduce(lambda a, b: (join_many if multiplied else join)(a, b, keys, how, **options), tables)


def join_many(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", **options) -> DataFrame:
    """join, where few keys may have many rows on both sides: what they give is no task's burden. Left rows are dealt out evenly and meet a
    broadcast right side, or one that has its rows once for each of some shares of the left rows."""
    form = options.get("form", "trim-casefold")
    parts = [p.alias(f"k{i}") for i, p in enumerate(key_parts(right, keys, form))]
    rows, most = right.select(*parts).groupBy(*[f"k{i}" for i in range(len(parts))]).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if how not in ("inner", "left") or not most or most == 1:
        return join(left, right, keys, how, **options)
    spark = left.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rows <= BROADCAST_ROWS:
        return join(left.repartition(n), F.broadcast(right), keys, how, **options)
    share = next(x for x in (f"_share{i}" for i in count()) if x not in left.columns and x not in right.columns)
    own = [F.col(X.quoted(f.name)) for f in left.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    l = left.withColumn(share, F.pmod(F.xxhash64(*own), F.lit(n)))
    r = right.withColumn(share, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return join(l, r, [*keys, share], how, **options).drop(share)


def diagnostics(left: DataFrame, right: DataFrame, keys: Sequence[str], form: str = "trim-casefold") -> DataFrame:
    """One row: rows and keys of both sides, rows without a key, repeated keys, matches, and the cardinality of what matches."""
    count = lambda df, side: _keyed(df, keys, form, side).groupBy(*[f"{side}{i}" for i in range(len(keys))]).agg(F.count("*").alias(f"n_{side}"))
    l, r = count(left, "l"), count(right, "r")
    both = l.join(r, _matched(l, r, keys), "full")
    whole = lambda side: reduce(lambda a, b: a & b, [F.col(f"{side}{i}").isNotNull() for i in range(len(keys))])
    match = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = both.agg(
        *[x for side, name in (("l", "left"), ("r", "right")) for x in (
            total(f"n_{side}", F.col(f"n_{side}").isNotNull()).alias(f"{name}_rows"),
            total(f"n_{side}", F.col(f"n_{side}").isNotNull() & ~whole(side)).alias(f"{name}_missing_key"),
            F.count_if(whole(side) & (F.col(f"n_{side}") > 1)).alias(f"{name}_duplicate_keys"),
            total(f"n_{side}", match).alias(f"{name}_matched_rows"))],
        F.count_if(match).alias("matched_keys"),
        F.coalesce(F.max(F.when(match, F.col("n_l"))), F.lit(0)).alias("_ml"),
        F.coalesce(F.max(F.when(match, F.col("n_r"))), F.lit(0)).alias("_mr"),
    )
    label = F.when((F.col("_ml") > 1) & (F.col("_mr") > 1), "many-to-many").when((F.col("_ml") > 1) | (F.col("_mr") > 1), "one-to-many").otherwise("one-to-one")
    return out.withColumn("cardinality", label).drop("_ml", "_mr")


def conflicts(left: DataFrame, right: DataFrame, keys: Sequence[str], form: str = "trim-casefold") -> DataFrame:
    """column, left_value, right_value and the keys of each pair of matching rows that differ in a shared column."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    l, r = _keyed(left, keys, form, "l"), _keyed(right, keys, form, "r")
    met = l.join(r, _matched(l, r, keys))
    text = lambda side, df, c: X.as_text(F.col(f"{side}.{X.quoted(c)}"), df.schema[c].dataType)
    cells = [F.struct(F.lit(c).alias("column"), text("l", left, c).alias("left_value"), text("r", right, c).alias("right_value")) for c in shared]
    if not cells:
        return met.select(*[F.col(f"l.{X.quoted(k)}").alias(k) for k in keys], F.lit("").alias("column"), F.lit("").alias("left_value"), F.lit("").alias("right_value")).where("false")
    flat = met.select(*[F.col(f"l.{X.quoted(k)}").alias(k) for k in keys], F.explode(F.array(*cells)).alias("_c"))
    return flat.where("_c.left_value <> _c.right_value").select(*keys, "_c.*")
