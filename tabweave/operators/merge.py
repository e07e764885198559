"""Keyed three-way merge of a base and two edited tables.

Equal rows stay; a row that one side left alone comes from the other, additions and
deletions included; where both changed a row, cells that only one side changed or that
agree are not in conflict. Such a row starts from ours (theirs if ours lacks it), so a
cell that only theirs changed there is not taken over; `cell_merge` takes it.
Conflicting cells go by `resolution`: fail, ours, theirs, base or mark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .joins import JoinError, key_parts

RESOLUTIONS = ("fail", "ours", "theirs", "base", "mark")
_SIDES = ("base", "ours", "theirs")


def _side(df: DataFrame, keys: Sequence[str], columns: Sequence[str], form: str, name: str, order: str | None = None) -> DataFrame:
    cells = [(X.text(df, c) if c in df.columns else F.lit("")).alias(c) for c in columns]
    place = [F.col(order).alias(f"{name}_order")] if order else []
    return df.select(*[p.alias(f"k{i}") for i, p in enumerate(key_parts(df, keys, form))], F.struct(*cells).alias(name), *place)


def problems(sides: dict[str, DataFrame], keys: Sequence[str], form: str = "trim-casefold") -> list[str]:
    """Sides whose keys are blank or repeat."""
    out = []
    for name, df in sides.items():
        parts = [p.alias(f"k{i}") for i, p in enumerate(key_parts(df, keys, form))]
        blank = reduce(lambda a, b: a | b, [F.col(f"k{i}").isNull() for i in range(len(parts))])
        n = df.select(*parts).groupBy(*[f"k{i}" for i in range(len(parts))]).count()
        r = n.agg(F.count_if(~blank & (F.col("count") > 1)), F.coalesce(F.sum(F.when(blank, F.col("count"))), F.lit(0))).first()
        out += [f"{name}: {r[0]} repeated keys"] * bool(r[0]) + [f"{name}: {r[1]} rows without a key"] * bool(r[1])
    return out


def _joined(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str], columns: Sequence[str], form: str, order: str | None = None) -> DataFrame:
    on = [f"k{i}" for i in range(len(keys))]
    sides = [_side(d, keys, columns, form, n, order) for d, n in zip((base, ours, theirs), _SIDES, strict=True)]
    return sides[0].join(sides[1], on, "full").join(sides[2], on, "full")


def _conflict(c: str) -> Column:
    b, o, t = (F.coalesce(F.col(f"{s}.{X.quoted(c)}"), F.lit("")) for s in _SIDES)
    return (o != t) & (o != b) & (t != b)


def _both_changed() -> Column:
    return ~(F.col("ours").eqNullSafe(F.col("theirs")) | F.col("ours").eqNullSafe(F.col("base")) | F.col("theirs").eqNullSafe(F.col("base")))


def conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str], form: str = "trim-casefold") -> DataFrame:
    """Keys, column and the three texts of each cell in conflict."""
    columns = list(dict.fromkeys(c for d in (base, ours, theirs) for c in d.columns))
    cells = [F.when(_conflict(c), F.struct(F.lit(c).alias("column"), *[F.coalesce(F.col(f"{s}.{X.quoted(c)}"), F.lit("")).alias(s) for s in _SIDES])) for c in columns]
    met = _joined(base, ours, theirs, keys, columns, form).where(_both_changed())
    return met.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.explode(F.array_compact(F.array(*cells))).alias("_c")).select(*keys, "_c.*")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str] = (), resolution: str = "fail", form: str = "trim-casefold", cell_merge: bool = False, check: bool = True, order: str | None = None) -> DataFrame:
    """The merged table as text; no keys: the first column. Raises JoinError for bad keys or, with 'fail', for conflicts.

    order: a column that holds each side's row order. The result then has base_order, ours_order and theirs_order after
    its own columns; sorted by these, nulls last, it has the base's rows first, then what ours and theirs added.
    """
    if resolution not in RESOLUTIONS:
        raise JoinError(f"unknown resolution: {resolution}")
    keys = list(keys) or base.columns[:1]
    columns = [c for c in dict.fromkeys(c for d in (base, ours, theirs) for c in d.columns) if c != order]
    if check and (bad := problems(dict(zip(_SIDES, (base, ours, theirs), strict=True)), keys, form)):
        raise JoinError("; ".join(bad))
    if resolution == "fail" and (n := conflicts(*[d.drop(order) if order else d for d in (base, ours, theirs)], keys, form).count()):
        raise JoinError(f"{n} cells are in conflict")
    met = _joined(base, ours, theirs, keys, columns, form, order)
    same, o_is_b, t_is_b = (F.col(a).eqNullSafe(F.col(b)) for a, b in (("ours", "theirs"), ("ours", "base"), ("theirs", "base")))
    whole = F.when(same, F.coalesce("ours", "theirs")).when(o_is_b, F.col("theirs")).when(t_is_b, F.col("ours"))

    def cell(c: str) -> Column:
        b, o, t = (F.coalesce(F.col(f"{s}.{X.quoted(c)}"), F.lit("")) for s in _SIDES)
        mark = F.concat(F.lit("<<<<<<< ours\n"), o, F.lit("\n=======\n"), t, F.lit("\n>>>>>>> theirs"))
        chosen = {"theirs": t, "base": b, "mark": mark}.get(resolution, o)
        kept = F.when(F.col("ours").isNotNull(), o).otherwise(t)
        if cell_merge:
            kept = F.when(o == b, t).otherwise(o)
        return F.when(_conflict(c), chosen).otherwise(kept).alias(c)

    both = F.struct(*[cell(c) for c in columns])
    picked = met.withColumn("_row", F.when(~_both_changed(), whole).otherwise(both))
    return picked.where("_row is not null").select("_row.*", *[f"{s}_order" for s in _SIDES if order])
