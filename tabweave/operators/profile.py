"""Quality profile, column types, facets, schema drift and row inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import kept

#: Texts that count as null.
NULL_TEXTS = ("null", "NULL")
#: Kinds from weakest to strongest.
KINDS = ("empty", "boolean", "number", "datetime", "text")
PROFILE_KINDS = ("boolean", "date", "datetime", "integer", "number", "string")


def melted(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value): a row for each cell, as text."""
    columns = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), X.text(df, c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).select("_c.*")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): all later figures come from these partial sums, so each cell is looked at once."""
    return melted(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each column: rows, blanks, nulls, distinct values, duplicates, type with its share, numeric figures."""
    v = value_counts(df, columns).withColumn("kind", X.profile_type(F.col("value")))
    n, full = F.col("n"), X.strip(F.col("value")) != ""
    null = F.col("value").isin(*NULL_TEXTS)
    real = full & ~null
    number = F.when(real & F.col("kind").isin("integer", "number"), X.as_number(F.col("value")))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    kinds = F.array(*[F.struct(of(real & (F.col("kind") == k)).alias("n"), F.lit(k).alias("kind")) for k in PROFILE_KINDS])
    out = v.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        of(full).alias("non_empty_count"),
        of(~full).alias("blank_count"),
        of(null).alias("null_count"),
        F.count_if(real).alias("distinct_count"),
        of(real).alias("_real"),
        F.array_sort(kinds, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["kind"] < b["kind"], -1).otherwise(1)).alias("_kinds"),
        of(number.isNotNull()).alias("numeric_count"),
        F.min(number).alias("numeric_min"),
        F.max(number).alias("numeric_max"),
        (F.sum(number * n) / F.sum(F.when(number.isNotNull(), n))).alias("numeric_mean"),
    )
    top = F.col("_kinds")[0]
    kind = F.when(F.col("_real") == 0, "empty").otherwise(top["kind"])
    share = F.when(F.col("_real") > 0, top["n"] / F.col("_real")).otherwise(F.lit(0.0))
    return out.select(
        "column", "row_count", "non_empty_count", "blank_count", "null_count", "distinct_count", (F.col("_real") - F.col("distinct_count")).alias("duplicate_count"),
        (F.col("distinct_count") == F.col("_real")).alias("unique"), kind.alias("type"), share.alias("confidence"), "numeric_count", "numeric_min", "numeric_max", "numeric_mean",
    )


def bounded(df: DataFrame, columns: Sequence[str] | None = None, most: int = 100_000) -> DataFrame:
    """The figures of `profile` with at most `most` distinct values of a column counted exactly.

    One aggregate over the table has all counts and a sketch of each column's values (about
    16 KB a column and task), so values are shuffled only for columns whose sketch says at
    most twice `most`; these are counted exactly. distinct_exact tells whether distinct_count
    is exact or, at `most`, a lower bound; then duplicate_count and unique are null, and
    distinct_estimate is the sketch's.
    """
    columns = list(columns or df.columns)

    # each cell is parsed once, below the aggregate
    cells = []
    for i, c in enumerate(columns):
        value = X.text(df, c)
        kind = X.profile_type(value)
        cells += [value.alias(f"v{i}"), kind.alias(f"k{i}"), F.when(kind.isin("integer", "number"), X.as_number(value)).alias(f"x{i}")]

    def figures(i: int) -> list[Column]:
        value, kind = F.col(f"v{i}"), F.col(f"k{i}")
        full, null = X.strip(value) != "", value.isin(*NULL_TEXTS)
        real = full & ~null
        own, number = F.when(real, value), F.when(real, F.col(f"x{i}"))
        named = {"n": F.count("*"), "full": F.count_if(full), "null": F.count_if(null), "real": F.count_if(real), "sketch": F.hll_sketch_estimate(F.hll_sketch_agg(own, 14)), "numbers": F.count(number), "min": F.min(number), "max": F.max(number), "mean": F.avg(number)}
        return [x.alias(f"{i}_{n}") for n, x in (named | {k: F.count_if(real & (kind == k)) for k in PROFILE_KINDS}).items()]

    found = df.select(*cells).agg(*[x for i in range(len(columns)) for x in figures(i)]).first()
    small = [c for i, c in enumerate(columns) if (found[f"{i}_sketch"] or 0) <= 2 * most]
    values = melted(df.select(*[F.col(X.quoted(c)) for c in small]), small).where((X.strip(F.col("value")) != "") & ~F.col("value").isin(*NULL_TEXTS)) if small else None
    exact = {r["column"]: r["n"] for r in values.distinct().groupBy("column").agg(F.count("*").alias("n")).collect()} if small else {}
    rows = []
    for i, c in enumerate(columns):
        at = {k.partition("_")[2]: v for k, v in found.asDict().items() if k.startswith(f"{i}_")}
        n = exact.get(c, 0) if c in small else most + 1
        whole, kinds = n <= most, sorted(((-at[k], k) for k in PROFILE_KINDS))
        kind, share = (kinds[0][1], -kinds[0][0] / at["real"]) if at["real"] else ("empty", 0.0)
        rows.append((c, at["n"], at["full"], at["n"] - at["full"], at["null"], min(n, most), whole, int(at["sketch"] or 0), at["real"] - n if whole else None, n == at["real"] if whole else None, kind, share, at["numbers"], at["min"], at["max"], at["mean"]))
    return df.sparkSession.createDataFrame(
        rows, "column string, row_count long, non_empty_count long, blank_count long, null_count long, distinct_count long, distinct_exact boolean, distinct_estimate long, duplicate_count long, unique boolean, type string, confidence double, numeric_count long, numeric_min double, numeric_max double, numeric_mean double"
    )


def facets(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, value, n, rank): the k most frequent values of each column, ties in order of the value."""
    counts = value_counts(df, columns)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def facet_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows whose cell is exactly the value."""
    return df.where(X.text(df, column) == value)


def samples(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = 3) -> DataFrame:
    """(column, value, rank): the first k distinct values of each column that aren't blank."""
    order = F.struct(*[F.col(X.quoted(c)) for c in order_by])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), X.text(df, c).alias("value")) for c in columns])
    first = df.select(order.alias("o"), F.explode(cells).alias("c")).select("o", "c.*").where(X.strip(F.col("value")) != "").groupBy("column", "value").agg(F.min("o").alias("o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("o", "value"))).where(F.col("rank") <= k).drop("o")


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each column: counts of each kind and the kind that holds for all."""
    v = value_counts(df, columns).withColumn("kind", X.value_type(F.col("value")))
    out = v.groupBy("column").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in KINDS])
    strongest = F.when(F.col("n_text") > 0, "text").when(F.col("n_datetime") > 0, "datetime").when(F.col("n_number") > 0, "number").when(F.col("n_boolean") > 0, "boolean").otherwise("empty")
    return out.withColumn("type", strongest)


def drift(tables: dict[str, DataFrame]) -> dict:
    """Columns of each input, of all inputs and those in common; only schemas are looked at."""
    union = list(dict.fromkeys(c for d in tables.values() for c in d.columns))
    common = [c for c in union if all(c in d.columns for d in tables.values())]
    files = {n: {"columns": d.columns, "types": dict(d.dtypes), "missing": [c for c in union if c not in d.columns]} for n, d in tables.items()}
    return {"files": files, "union_columns": union, "common_columns": common, "drift": len(union) > len(common)}


def numbered(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_number") -> DataFrame:
    """df with 1-based row numbers in the given order: ranges are sorted apart, then shifted by the rows before them."""
    order = [F.col(X.quoted(c)) if isinstance(c, str) else c for c in order_by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    local = kept(local)
    before = local.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row for each range
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_n", "_before")


def inspect_row(df: DataFrame, number: int, order_by: Sequence[str], name: str = "row_number") -> DataFrame:
    """Row `number` (from 1) in the given order: rows are counted by ranges of the order, and only the range that holds it is sorted."""
    order = F.struct(*[F.col(X.quoted(c)) for c in order_by]).alias("_key")
    keyed = df.withColumn("_key", order)
    low, before, high = None, 0, None
    while True:
        inside = keyed.where((F.lit(True) if low is None else F.col("_key") >= low) & (F.lit(True) if high is None else F.col("_key") < high))
        cuts = _cuts(inside)
        # a row for each range: how many rows it has
        place = F.size(F.filter(F.array(*cuts), lambda c: c <= F.col("_key"))) if cuts else F.lit(0)
        counts = {r["p"]: r["n"] for r in inside.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()}
        at = 0
        while at <= len(cuts) and before + counts.get(at, 0) < number:
            before, at = before + counts.get(at, 0), at + 1
        if at > len(cuts):
            return df.limit(0).withColumn(name, F.lit(number).cast("long"))
        shrunk = counts[at] < sum(counts.values())
        low, high = (cuts[at - 1] if at else low), (cuts[at] if at < len(cuts) else high)
        if counts[at] <= _SORTED or not shrunk:
            part = keyed.where((F.lit(True) if low is None else F.col("_key") >= low) & (F.lit(True) if high is None else F.col("_key") < high))
            # the range's first rows up to the one that is asked for
            return part.orderBy("_key").offset(number - before - 1).limit(1).drop("_key").withColumn(name, F.lit(number).cast("long"))


#: Rows of a range that are sorted for one of them, and ranges that a step cuts.
_SORTED, _RANGES = 100_000, 32


def _cuts(df: DataFrame) -> list[Column]:
    """Keys that cut df into ranges of about equal size: quantiles of a sample of at most some thousand rows."""
    n = df.count()
    if n <= _SORTED:
        return []
    keys = df.select("_key").sample(min(1.0, 4096 / n), seed=7).distinct().orderBy("_key").collect()
    step = max(1, len(keys) // _RANGES)
    kinds = df.schema["_key"].dataType
    return [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r[0], kinds.fields, strict=True)]) for r in keys[step::step]]
