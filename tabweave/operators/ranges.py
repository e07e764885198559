"""Joins by ranges: a value with the intervals that hold it, by equal keys of bins instead of a nested loop.

An interval belongs to the level of the smallest power of two times `width` that is not
below its length, so it touches two bins of its level at most, however long it is. A value
has one bin on each level that occurs (64 at most). Values and intervals meet by keys,
level and bin, and the ends are tested exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _number(df: DataFrame, name: str) -> Column:
    """Points in time as seconds, other values as doubles."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(X.quoted(name))
    if kind == "timestamp_ntz":
        # by its fields: no zone's gaps come in
        return (F.unix_date(c.cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60).cast("double") + F.extract(F.lit("SECOND"), c).cast("double")
    if kind in ("timestamp", "date"):
        return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    return c.cast("double")


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, on: Sequence[str] = (), how: str = "inner", width: float | None = None) -> DataFrame:
    """Rows of `points` with the rows of `intervals` for which start <= point <= end and the columns `on` are equal.

    how: inner, left (points without an interval stay) or semi. Null points and ends meet
    nothing, and neither do intervals that end before they start. Other columns must have
    names of their own. width: of the narrowest bins; the median length where not given.
    """
    low, high = _number(intervals, start), _number(intervals, end)
    own = intervals.where(high >= low).withColumns({"_low": low, "_high": high})
    if width is None:
        width = own.agg(F.percentile_approx(F.col("_high") - F.col("_low"), 0.5)).first()[0] or 1.0
    # one step wider where rounding has put a length on its bound
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col("_high") - F.col("_low")) / width, F.lit(1.0))))).cast("int")
    own = own.withColumn("_level", level)
    levels = sorted(r[0] for r in own.select("_level").distinct().collect())
    bin_of = lambda c, l: F.floor(c / (F.lit(float(width)) * F.pow(F.lit(2.0), l)))
    bins = F.sequence(bin_of(F.col("_low"), F.col("_level")), bin_of(F.col("_high"), F.col("_level")))
    right = own.withColumn("_bin", F.explode(bins))
    at = _number(points, point)
    left = points.withColumn("_at", at)
    if how == "left":
        left = left.withColumn("_row", F.monotonically_increasing_id())
    placed = left.where(F.col("_at").isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"))).withColumn("_bin", bin_of(F.col("_at"), F.col("_level")))
    names = [*points.columns, *[c for c in intervals.columns if c not in on]]
    keys = ["_level", "_bin", *on]
    hit = (F.col(X.quoted(point)) >= F.col(X.quoted(start))) & (F.col(X.quoted(point)) <= F.col(X.quoted(end)))
    if how == "semi":
        met = placed.join(right, keys).where(hit)
        return met.select(*[F.col(X.quoted(c)) for c in points.columns], "_at").drop("_at").distinct()
    met = placed.join(right, keys).where(hit)
    if how == "inner":
        return met.select(*[F.col(X.quoted(c)) for c in names])
    found = met.select("_row", *[F.col(X.quoted(c)) for c in names])
    lone = left.join(found.select("_row").distinct(), "_row", "left_anti")
    empty = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in intervals.columns if c not in on]
    return found.drop("_row").unionAll(lone.select(*[F.col(X.quoted(c)) for c in points.columns], *empty))
