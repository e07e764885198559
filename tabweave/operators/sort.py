"""Sorts that know numbers and dates in text, and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def sort_keys(df: DataFrame, name: str, numeric_aware: bool = True, case_sensitive: bool = False, collation: str | None = None) -> list[Column]:
    """Keys of one column: numbers before dates before words; nulls and blanks first. Descending turns all of that round."""
    kind, cell = df.schema[name].dataType, X.text(df, name)
    words = cell if case_sensitive else F.lower(cell)
    words = F.collate(words, collation) if collation else words
    if not numeric_aware:
        return [words]
    if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [F.col(X.quoted(name))]
    n, t = X.as_number(cell), X.as_timestamp(cell)
    bucket = F.when(n.isNotNull(), 0).when(t.isNotNull(), 1).otherwise(2)
    return [bucket, n, F.when(n.isNull(), t), F.when(n.isNull() & t.isNull(), words)]


def projected(df: DataFrame, by: Sequence[tuple[str, bool]], ties: Sequence[str] = (), **options) -> tuple[DataFrame, list[Column]]:
    """df with its sort keys as columns of their own (named `_sort...`), and the order by them.

    So numbers and dates are parsed once a row, not in each comparison.
    """
    keys = [(k, ascending) for name, ascending in by for k in sort_keys(df, name, **options)]
    names = [f"_sort{i}" for i in range(len(keys))]
    order = [F.col(n).asc_nulls_first() if ascending else F.col(n).desc_nulls_last() for n, (_, ascending) in zip(names, keys, strict=True)]
    return df.withColumns({n: k for n, (k, _) in zip(names, keys, strict=True)}), [*order, *[F.col(X.quoted(c)).asc() for c in ties]]


def sort(df: DataFrame, by: Sequence[tuple[str, bool]], ties: Sequence[str] = (), **options) -> DataFrame:
    """Rows by (column, ascending) pairs; ties in the order of the columns `ties`."""
    keyed, order = projected(df, by, ties, **options)
    return keyed.orderBy(*order).drop(*[c for c in keyed.columns if c not in df.columns])


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, if it has at most `rows` rows; else an error: a bound is not a cut."""
    if len(df.limit(rows + 1).select(F.lit(1)).collect()) > rows:
        raise OverflowError(f"the result has more than {rows} rows")
    return df


def preview(df: DataFrame, rows: int = 100, scan_rows: int = 5000, columns: int = 256, cell_bytes: int = 16 << 10) -> DataFrame:
    """First rows of a bounded scan, cells clipped."""
    out = df.limit(scan_rows).limit(rows)
    return out.select(*[clip(X.text(df, c), cell_bytes).alias(c) for c in df.columns[:columns]])


def clip(c: Column, size: int) -> Column:
    """At most `size` bytes of UTF-8, whole characters, with an ellipsis if anything went."""
    data = F.encode(c, "UTF-8")
    # a cut may fall inside a character: up to three of its bytes go
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, max(size - k, 0)).cast("string")) for k in range(4)])
    return F.when(F.octet_length(c) > size, F.concat(whole, F.lit("…"))).otherwise(c)


def fitting(df: DataFrame, rows: int, size: int) -> int:
    """How many of the first rows, `rows` at most, have no more than `size` bytes of text together.

    Only the rows' sizes come to the driver, taken from the first partitions, four times as
    many each time, until they are too many or too large.
    """
    cells = [F.coalesce(F.octet_length(F.col(X.quoted(c)).cast("string")), F.lit(0)) for c in df.columns]
    sizes = df.select(sum(cells, F.lit(0)).cast("long").alias("n"))
    n = min(rows, 16)
    while True:
        found = [r["n"] for r in sizes.take(n)]
        fit, total = 0, 0
        for x in found:
            total += x
            if total > size:
                return fit
            fit += 1
        if len(found) < n or n >= rows:
            return fit
        n = min(rows, 4 * n)
