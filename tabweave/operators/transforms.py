"""Scalar transforms in their fixed order: default for absent cells, global case, column
transforms as declared, rename, then splits, merges and computed columns.

Splits, merges and computed columns read the row as it came in and fall back to
columns made before them. All of it is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import compute
from .filters import java_pattern

#: Column names whose cells are always redacted.
SENSITIVE_NAMES = {
    "ssn", "social_security", "socialsecurity", "credit_card", "creditcard", "card_number", "cardnumber", "cvv",
    "email", "e_mail", "phone", "password", "secret", "token", "api_key", "apikey",
}
#: Cells that are redacted wherever they stand (social security number, card number, e-mail address).
SENSITIVE_CELLS = (r"^\d{3}-\d{2}-\d{4}$", r"^\d{13,19}$", r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def java_replacement(replacement: str) -> str:
    r"""\1 and \g<name> become $1 and ${name}; other backslashes and dollars are literal."""
    out = replacement.replace("$", "\\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else "${" + m[1] + "}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


def _one(c: Column, transform: Sequence) -> Column:
    kind, args = transform[0], transform[1:]
    if kind == "trim":
        return X.strip(c)
    if kind == "upper":
        return F.upper(c)
    if kind == "lower":
        return F.lower(c)
    if kind == "title":
        return X.title(c)
    if kind == "replace" and len(args) >= 2:
        return F.replace(c, F.lit(args[0]), F.lit(args[1])) if args[0] else c
    if kind == "regex_replace" and len(args) >= 2:
        try:
            return F.regexp_replace(c, java_pattern(args[0]), java_replacement(args[1]))
        except re.error:
            return c
    return c


def split_parts(c: Column, delimiter: str, parts: int) -> list[Column]:
    found = F.split(c, re.escape(delimiter) if delimiter else "(?!)", parts)
    return [F.coalesce(X.strip(F.try_element_at(found, F.lit(i + 1))), F.lit("")) for i in range(parts)]


def apply(df: DataFrame, transforms: Sequence[Sequence] = (), case: str = "none", empty_value: str = "", renames: dict[str, str] | None = None, fill_blank: bool = False, order: Sequence[str] = ("_file", "_ord")) -> DataFrame:
    """df as text columns, transformed; columns not named in a transform keep their place, those of its `order` go last as they are."""
    renames = renames or {}
    hidden = [c for c in df.columns if c in order]
    source = {c: X.text(df, c) for c in df.columns if c not in hidden}
    out: dict[str, Column] = {}
    for c in source:
        raw = F.col(X.quoted(c))
        v = F.when(raw.isNull(), F.lit(empty_value)).otherwise(source[c]) if empty_value else source[c]
        if fill_blank:
            v = F.when(X.strip(v) == "", F.lit(empty_value)).otherwise(v)
        v = {"upper": F.upper, "lower": F.lower, "title": X.title}.get(case, lambda x: x)(v)
        for t in transforms:
            if t[0] == c and t[1] not in ("split", "merge", "compute"):
                v = _one(v, t[1:])
        out[renames.get(c, c)] = v

    def cell(name: str) -> Column:
        return source[name] if name in source else out.get(name, F.lit(""))

    for t in transforms:
        if len(t) >= 3 and t[1] == "split":
            for i, part in enumerate(split_parts(cell(t[0]), t[2], int(t[3]) if len(t) > 3 else 2)):
                out[f"{t[0]}_{i + 1}"] = part
    for t in transforms:
        if len(t) >= 4 and t[1] == "merge":
            out[t[0]] = F.concat_ws(t[2], *[cell(c) for c in t[3:]])
    for t in transforms:
        if len(t) >= 3 and t[1] == "compute":
            out[t[0]] = compute.column(t[2], cell)
    return df.select(*[v.alias(c) for c, v in out.items()], *hidden)


def redact(df: DataFrame, token: str = "[REDACTED]", columns: Sequence[str] | None = None) -> DataFrame:
    """Cells of sensitive columns, and cells that look sensitive, become the token."""
    out = []
    for c in df.columns:
        cell, name = X.text(df, c), re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_")
        if columns is not None and c not in columns:
            out.append(F.col(X.quoted(c)))
        elif name in SENSITIVE_NAMES:
            out.append(F.lit(token).alias(c))
        else:
            s = X.strip(cell)
            hit = s.rlike(SENSITIVE_CELLS[0]) | s.rlike(SENSITIVE_CELLS[1]) | s.rlike(SENSITIVE_CELLS[2])
            out.append(F.when(hit, token).otherwise(cell).alias(c))
    return df.select(*out)
