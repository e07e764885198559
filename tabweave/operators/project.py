"""Column selection, order, renames and the union of inputs by column name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


class MappingError(ValueError):
    """A rename that can't be applied."""


def select(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Chosen columns in df's own order, then preferred ones first; unknown names are passed over."""
    kept = [c for c in df.columns if (columns is None or c in columns) and c not in exclude]
    first = [c for c in order if c in kept]
    return df.select(*[F.col(X.quoted(c)) for c in first + [c for c in kept if c not in first]])


def checked_mapping(mapping: dict[str, str], columns: Sequence[str]) -> dict[str, str]:
    """The mapping with outer white space gone; raises MappingError for one that loses or mixes columns."""
    clean = {str(k).strip(): str(v).strip() for k, v in mapping.items()}
    if any(not k or not v for k, v in clean.items()):
        raise MappingError("a rename needs both names")
    if len(set(clean.values())) < len(clean):
        raise MappingError("two columns are renamed to one name")
    if missing := [k for k in clean if k not in columns]:
        raise MappingError(f"columns to rename are absent: {', '.join(missing)}")
    if taken := [v for v in clean.values() if v in columns and v not in clean]:
        raise MappingError(f"new names are taken: {', '.join(taken)}")
    return clean


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(checked_mapping(mapping, df.columns))


#: Where a header is cut into words: signs between them, and a capital after a small letter or digit or before a small one.
_CUT = re.compile(r"[\s._-]+|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z\d])(?=[A-Z])")
#: What each mode (fixed values: the names) makes of a header without outer white space.
_MODES = {
    "none": lambda name: name,
    "trim": lambda name: name.removeprefix("\ufeff"),
    "lowercase": lambda name: name.removeprefix("\ufeff").lower(),
    "snake_case": lambda name: "_".join(filter(None, _CUT.split(name.removeprefix("\ufeff")))).lower(),
}


def header(name: str, mode: str = "none") -> str:
    """A header's name in mode none, trim, lowercase or snake_case."""
    return _MODES.get(mode, _MODES["trim"])(name.strip())


def normalized_headers(df: DataFrame, mode: str) -> DataFrame:
    """df with its headers normalised; of columns that fall together the last one counts."""
    names = [header(c, mode) for c in df.columns]
    last = {n: c for n, c in zip(names, df.columns, strict=True)}
    return df.select(*[F.col(X.quoted(c)).alias(n) for n, c in last.items()])


def union(inputs: Sequence[DataFrame], mode: str = "union") -> DataFrame:
    """Rows of all inputs by column name; mode union, intersection or first_file chooses the columns."""
    if mode == "intersection":
        names = [c for c in inputs[0].columns if all(c in d.columns for d in inputs)]
    elif mode == "first_file":
        names = inputs[0].columns
    else:
        names = list(dict.fromkeys(c for d in inputs for c in d.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs).select(*[F.col(X.quoted(c)) for c in names])
