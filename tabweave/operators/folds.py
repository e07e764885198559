"""Values of a group put together two by two, in order: first, sum, min, max, concat.

Sums, minima and maxima of numeric columns are ordinary aggregates with partial sums, and
so are sums of text: a group's sum is its first cell that isn't blank, if that is a word,
else the sum of its numbers; words after a number change nothing. Minima and maxima of
text, where numbers and words may mix, and concat, whose result holds the group's texts
anyway, depend on the order: there a group's values are gathered, put in order and
folded, and must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def step(left: Column, right: Column, mode: str, separator: str = "; ") -> Column:
    """Two cell texts put together."""
    if mode == "concat":
        skip = (right == "") | (right == left)
        return F.when(left == "", right).when(skip, left).otherwise(F.concat(left, F.lit(separator), right))
    if mode not in ("sum", "min", "max"):
        return left
    a, b = X.as_number(left), X.as_number(right)
    numbers = {"sum": a + b, "min": F.least(a, b), "max": F.greatest(a, b)}[mode]
    words = {"sum": F.when(left != "", left).otherwise(right), "min": F.least(left, right), "max": F.greatest(left, right)}[mode]
    return F.when(a.isNull() | b.isNull(), words).otherwise(X.number_text(numbers))


def folded(c: Column, kind: T.DataType, order: Column, mode: str, separator: str = "; ") -> Column:
    """Aggregate: the fold of a column's values in the order of `order`."""
    if mode == "first":
        return F.min_by(c, order)
    if isinstance(kind, T.NumericType) and mode in ("sum", "min", "max"):
        return {"sum": F.sum, "min": F.min, "max": F.max}[mode](c)
    cell = F.coalesce(X.as_text(c, kind), F.lit(""))
    if mode == "sum":
        number = X.as_number(cell)
        first = F.min_by(F.when(cell != "", cell), F.when(cell != "", order))
        return F.when(first.isNull(), "").when(X.as_number(first).isNull(), first).when(F.count(number) == 1, first).otherwise(X.number_text(F.sum(number)))
    values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), X.as_text(c, kind).alias("v")))), lambda x: x["v"])
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("")), lambda a, b: step(a, b, mode, separator))
