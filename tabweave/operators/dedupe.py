"""Duplicates: kept first or last, folded together, found by similarity, or only shown.

A group's first row is a grouped minimum, not a window: it is found by partial sums,
so a key that a third of all rows carry costs no task more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import Matcher
from ..session import kept
from .folds import folded


def key_of(df: DataFrame, c: str, case_sensitive: bool = False) -> Column:
    """A key part: its own value, or its text in lower case."""
    cell = X.text(df, c) if df.schema[c].dataType.simpleString() == "string" else F.col(X.quoted(c))
    return F.lower(cell) if df.schema[c].dataType.simpleString() == "string" and not case_sensitive else cell


def _keys(df: DataFrame, columns: Sequence[str] | None, case_sensitive: bool) -> list[Column]:
    return [key_of(df, c, case_sensitive).alias(f"_key{i}") for i, c in enumerate(columns or df.columns)]


def _order(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(X.quoted(c)) for c in order_by])


def distinct(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first", order_by: Sequence[str] = (), case_sensitive: bool = False, position: str | None = None) -> DataFrame:
    """One row of each key: the first in the order, or the last one's cells (at the first one's place, given as
    column `position`). 'none' is as 'first'."""
    order = _order(order_by or df.columns)
    row = F.struct(*[F.col(X.quoted(c)) for c in df.columns])
    pick = F.max_by(row, order) if keep == "last" else F.min_by(row, order)
    found = df.groupBy(*_keys(df, columns, case_sensitive)).agg(pick.alias("_row"), F.min(order).alias("_first"))
    place = [F.col("_first").alias(position)] if position else []
    return found.select("_row.*", *place)


def aggregate(df: DataFrame, columns: Sequence[str], mode: str, order_by: Sequence[str], separator: str = "; ", case_sensitive: bool = False) -> DataFrame:
    """One row of each key; key cells of its first row, all others folded."""
    order = _order(order_by)
    cells = [(F.min_by(F.col(X.quoted(c)), order) if c in columns else folded(F.col(X.quoted(c)), df.schema[c].dataType, order, mode, separator)).alias(c) for c in df.columns]
    return df.groupBy(*_keys(df, columns, case_sensitive)).agg(*cells).select(*[F.col(X.quoted(c)) for c in df.columns])


def preview(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], case_sensitive: bool = False, keep: str = "first") -> DataFrame:
    """Keys that more than one row carries: key, number of rows and the kept row's order."""
    order = _order(order_by)
    keys = _keys(df, columns, case_sensitive)
    kept = F.max(order) if keep == "last" else F.min(order)
    groups = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), kept.alias("kept")).where("n_rows > 1")
    return groups.withColumnsRenamed({f"_key{i}": c for i, c in enumerate(columns)})


def fuzzy(df: DataFrame, columns: Sequence[str], threshold: float = 90, order_by: Sequence[str] = (), block_by: Sequence[str] = (), block_rows: int | None = None, round_rows: int = 4000) -> DataFrame:
    """Rows that no earlier kept row of their block resembles; greedy in order, as a first-come clustering is.

    Rows meet only within a block (`block_by`, case ignored); without, all rows do. Round by
    round the first `round_rows` rows still open are gone through in order by one task, and
    every other open row is scored against those kept there, by all tasks. So the order of
    keeping holds, and work goes with rows times kept rows, never with a group's square.
    If `block_rows` is given, more rows in a block raise an error.
    """
    order, names = _order(order_by or df.columns), df.columns
    block = F.concat_ws("\x1f", *[key_of(df, c) for c in block_by]) if block_by else F.lit("")
    keyed = df.select(F.struct(*[F.col(X.quoted(c)) for c in names]).alias("_row"), block.alias("_block"), F.concat_ws(" ", *[X.text(df, c) for c in columns]).alias("_text"), order.alias("_order"))
    if block_rows is not None:
        largest = keyed.groupBy("_block").count().agg(F.max("count")).first()[0] or 0
        if largest > block_rows:
            raise ValueError(f"a block has {largest} rows, more than {block_rows}; name columns to block by")
    # of equal texts only the first can be kept
    firsts = kept(keyed.groupBy("_block", "_text").agg(F.min_by("_row", "_order").alias("_row"), F.min("_order").alias("_order")).withColumn("_id", F.monotonically_increasing_id()))
    undecided, chosen = firsts.select("_id", "_block", "_text", "_order"), []

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Matcher(threshold)
        for b in batches:
            use = []
            for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                use.append(not known.meets(k, t))
                if use[-1]:
                    known.add(k, t)
            yield b.filter(pa.array(use, pa.bool_()))

    while True:
        head = kept(undecided.orderBy("_order", "_id").limit(round_rows).select("_id", "_block", "_text", "_order").coalesce(1))
        if head.isEmpty():
            break
        new = kept(head.select("_id", "_block", "_text").mapInArrow(greedy, "_id long, _block string, _text string"))
        chosen.append(new.select("_id"))
        reps = [(r["_block"], r["_text"]) for r in new.collect()]
        rest = undecided.join(F.broadcast(head.select("_id")), "_id", "left_anti").select("_id", "_block", "_text", "_order")

        def unlike(batches: Iterator[pa.RecordBatch], reps: list[tuple[str, str]] = reps) -> Iterator[pa.RecordBatch]:
            known = Matcher(threshold)
            for k, t in reps:
                known.add(k, t)
            for b in batches:
                yield b.filter(pa.array([not known.meets(k, t) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.bool_()))

        undecided = kept(rest.mapInArrow(unlike, rest.schema))
    if not chosen:
        return df.limit(0)
    return firsts.join(reduce(DataFrame.union, chosen), "_id", "left_semi").select("_row.*")
