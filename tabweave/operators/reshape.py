"""Unpivot and pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .folds import folded


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """A row for each listed column of each row, blanks included; unknown columns are passed over."""
    ids, columns = [c for c in ids if c in df.columns], [c for c in columns if c in df.columns]
    kinds = {df.schema[c].dataType for c in columns}
    cells = df if len(kinds) <= 1 else df.withColumns({c: X.text(df, c) for c in columns})
    return cells.unpivot([F.col(X.quoted(c)) for c in ids], [F.col(X.quoted(c)) for c in columns], name, value)


def pivot(df: DataFrame, column: str, value: str, index: Sequence[str] | None = None, mode: str = "first", order_by: Sequence[str] = (), separator: str = "; ", values: Sequence[str] | None = None) -> DataFrame:
    """A row for each index, a column for each value of `column` in the order first met; missing cells are blank.

    The values are looked up first, as many as the result has columns; pass them to save that job.
    """
    index = [c for c in df.columns if c not in (column, value)] if index is None else list(index)
    order = F.struct(*[F.col(X.quoted(c)) for c in order_by or index])
    if values is None:
        met = df.groupBy(X.text(df, column).alias("v")).agg(F.min(order).alias("o")).orderBy("o")
        values = [r[0] for r in met.select("v").collect()]
    cell = folded(F.col(X.quoted(value)), df.schema[value].dataType, order, mode, separator)
    keyed = df.withColumn(column, X.text(df, column))
    out = keyed.groupBy(*[F.col(X.quoted(c)) for c in index]).pivot(column, list(values)).agg(cell)
    new = [c for c in out.columns if c not in index]
    blank = {c: F.coalesce(F.col(X.quoted(c)), F.lit("")) for c in new if out.schema[c].dataType.simpleString() == "string"}
    return out.withColumns(blank) if blank else out
