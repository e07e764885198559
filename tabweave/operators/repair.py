"""Reviewed repairs: guarded edits of single cells by row number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .profile import numbered

MOST_EDITS = 10_000


class RepairError(ValueError):
    """An edit that doesn't fit the rows."""


def repair(df: DataFrame, edits: Sequence[dict], order_by: Sequence[str]) -> DataFrame:
    """df with the edits {row, column, expected_old, new_value} made (edited columns become text); one that doesn't fit stops them all.

    Edits are bounded (10,000), so they are joined by broadcast.
    """
    if len(edits) > MOST_EDITS:
        raise RepairError(f"more than {MOST_EDITS} edits")
    wrong = [e for e in edits if e["column"] not in df.columns]
    if wrong or len({(e["row"], e["column"]) for e in edits}) < len(edits):
        raise RepairError("an edit names an absent column, or two edits name one cell")
    if not edits:
        return df
    rows = numbered(df, order_by, "_row")
    given = df.sparkSession.createDataFrame([(int(e["row"]), e["column"], str(e["expected_old"]), str(e["new_value"])) for e in edits], "_row long, c string, old string, new string")
    by_row = given.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("old", "new")))).alias("_edits"))
    met = rows.join(F.broadcast(by_row), "_row", "left")
    fits = sum((F.when(F.col("_edits")[c]["old"] == X.text(df, c), 1).otherwise(0) for c in {e["column"] for e in edits}), F.lit(0))
    done = met.where("_edits is not null").agg(F.coalesce(F.sum(fits), F.lit(0))).first()[0]
    if done != len(edits):
        raise RepairError(f"{len(edits) - done} edits don't find the value they expect")
    edited = {e["column"] for e in edits}
    return met.select(*[F.coalesce(F.col("_edits")[c]["new"], X.text(df, c)).alias(c) if c in edited else F.col(X.quoted(c)) for c in df.columns])
