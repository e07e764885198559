"""Text semantics of cells as Column expressions: a null cell is a blank one.

Typed columns pass through: `as_number` and `as_timestamp` parse only strings.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Timestamp patterns in the order they are tried, month before day.
DATE_PATTERNS = (
    "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d",
    "yyyy-M-d H:m:s", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s",
    "yyyy-M-d H:m", "M/d/yyyy H:m", "d/M/yyyy H:m",
    "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy",
)
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?([+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
_MAIL = r"(?i)^([a-z]{3}, )?\d{1,2} [a-z]{3} \d{4} \d{2}:\d{2}(:\d{2})? [+-]\d{4}$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Every run of letters starts in upper case, also after an apostrophe or a digit."""
    return _title(c)


@F.pandas_udf(T.StringType())
def _title(s: pd.Series) -> pd.Series:
    return s.str.title()


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def text(df: DataFrame, name: str) -> Column:
    """The cell as text, blank if null."""
    return as_text(F.col(quoted(name)), df.schema[name].dataType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_text(c: Column, kind: T.DataType) -> Column:
    """Text of a typed cell: True/False, 1.0, ISO timestamps; numbers beyond 1e16 in scientific form."""
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, T.BooleanType):
        out = F.initcap(c.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e16)
        plain = (F.abs(d) >= 1e-4) & (F.abs(d) < 1e16)
        spread = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", d), r"0+$", ""), r"\.$", ".0")
        short = F.when(d.cast("string").contains("E"), spread).otherwise(d.cast("string"))
        small = F.regexp_replace(F.regexp_replace(F.lower(d.cast("string")), r"\.0e", "e"), r"e(-?)(\d)$", "e$10$2")
        special = F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf")
        out = F.coalesce(special, F.when(whole, F.concat(d.cast("decimal(38,0)").cast("string"), F.lit(".0"))).when(plain, short).otherwise(F.regexp_replace(small, r"e(\d)", "e+$1")))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(c, "SSSSSS")
        out = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def as_number(c: Column, kind: T.DataType | None = None) -> Column:
    """The cell as a double, null if it isn't one: commas go, digits may be grouped by underscores, inf and nan count."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    s = F.regexp_replace(F.replace(strip(c), F.lit(","), F.lit("")), r"(?<=\d)_(?=\d)", "")
    return F.when(s.rlike(_NUMBER) | s.rlike(_SPECIAL), s.try_cast("double"))


def as_timestamp(c: Column, kind: T.DataType | None = None) -> Column:
    """The cell as a timestamp without zone (aware ones in UTC): ISO forms, the patterns above, then mail dates."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    s = strip(c)
    plain = F.replace(s, F.lit(","), F.lit(""))
    iso = F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"([T ]\d{2})($|[+Z-])", "$1:00$2")
    iso = F.regexp_replace(iso, r"([T ]\d{2}:\d{2})($|[+Z-])", "$1:00$2")
    zoned = F.when(s.rlike(_ISO) | s.rlike(_ISO[:-1] + "Z$"), iso.try_cast("timestamp"))
    basic = F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")))
    shapes = {"-": r"^\d{4}-", "/y": r"^\d{4}/", "/": r"^\d{1,2}/", "m": r"^[A-Za-z]", "d": r"^\d{1,2} [A-Za-z]"}
    kind_of = lambda p: "-" if p[4:5] == "-" else "/y" if p[4:5] == "/" else "/" if "/" in p else "m" if p[0] == "M" else "d"
    tried = [F.when(plain.rlike(shapes[kind_of(p)]), F.try_to_timestamp(plain, F.lit(p))) for p in DATE_PATTERNS]
    mail = F.when(s.rlike(_MAIL), F.coalesce(F.try_to_timestamp(F.regexp_replace(s, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy H:m:s Z")), F.try_to_timestamp(F.regexp_replace(s, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy H:m Z"))))
    return F.coalesce(zoned, basic, *tried, mail).cast("timestamp_ntz")


def value_type(c: Column) -> Column:
    """empty, boolean, number, datetime or text."""
    s = strip(c)
    return (
        F.when(s == "", "empty")
        .when(F.lower(s).isin("true", "false", "yes", "no"), "boolean")
        .when(as_number(s).isNotNull(), "number")
        .when(as_timestamp(s).isNotNull(), "datetime")
        .otherwise("text")
    )


def iso_date(c: Column) -> Column:
    return (c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()) | (c.rlike(r"^\d{8}$") & F.try_to_timestamp(c, F.lit("yyyyMMdd")).isNotNull())


def iso_datetime(c: Column) -> Column:
    return iso_date(c) | ((c.rlike(_ISO) | c.rlike(_ISO[:-1] + "Z$")) & as_timestamp(c).isNotNull())


def finite(c: Column) -> Column:
    """True for text that is a finite number once commas are gone."""
    n = as_number(c)
    return F.coalesce(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))


def profile_type(c: Column) -> Column:
    """empty, boolean, integer, number, date, datetime or string."""
    s = strip(c)
    return (
        F.when(s == "", "empty")
        .when(F.lower(s).isin("true", "false", "yes", "no"), "boolean")
        .when(s.rlike(r"^[-+]?\d+$"), "integer")
        .when(finite(s), "number")
        .when(iso_date(s), "date")
        .when(iso_datetime(s), "datetime")
        .otherwise("string")
    )


#: How keys are compared: exact, without outer white space, without case, or both.
KEY_FORMS: dict[str, Callable[[Column], Column]] = {
    "exact": lambda c: c,
    "trim": strip,
    "casefold": casefold,
    "trim-casefold": lambda c: casefold(strip(c)),
}


def number_text(n: Column) -> Column:
    """Text of a computed number: whole ones without a decimal point."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e18), n.cast("decimal(38,0)").cast("string")).when(n.isNotNull(), as_text(n, T.DoubleType()))
