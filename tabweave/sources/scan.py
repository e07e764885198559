"""Scans of delimited text, JSON Lines, Parquet and workbooks into DataFrames.

Hidden columns: `_file` (index of the input), `_ord` (place in it). Text scans keep
every cell as text; rows that don't fit the header are marked in `_bad` with their line,
the reason and the raw text. Inputs are named, measured and opened by Spark alone, so
they may be in any store that it reads.
"""

from __future__ import annotations

import csv
import io
import sys
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.project import header
from . import delimited, files

DELIMITED = {".csv", ".tsv", ".txt"}
#: Parts that Spark writes end in .json; folders are not searched for these, as they hold other documents too.
LINES = {".jsonl", ".ndjson", ".json"}
KNOWN = DELIMITED | LINES - {".json"} | {".parquet", ".xlsx"}
HIDDEN = ("_file", "_ord", "_bad")
#: Bytes of a file's beginning that are looked at for its header.
HEAD = 1 << 20
#: Why a row is bad.
RAGGED, NOT_JSON, NOT_OBJECT = "ragged row has missing or extra fields", "not valid JSON", "expected a JSON object"
_BAD = "struct<line:bigint,reason:string,raw:string>"


class InputError(ValueError):
    """An input that can't be read under the given rules."""


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    encoding: str = "utf-8"
    confidence: float = 0.95


@dataclass(frozen=True)
class Limits:
    """Admission bounds; None: no bound. A breach is an error, never a cut."""

    file_bytes: int | None = 512 << 20
    rows: int | None = 1_000_000
    columns: int | None = 16_384
    cell_bytes: int | None = 1 << 20
    json_depth: int | None = 32
    unpacked_bytes: int | None = 1 << 30


def expand(patterns: Sequence[str], recursive: bool = True, spark: SparkSession | None = None, parts: bool = False) -> list[str]:
    """Files of folders, globs and names, each once, in order of the lower-cased path; parts: JSON Lines that Spark wrote too."""
    return files.listed(spark or SparkSession.active(), patterns, KNOWN | LINES if parts else KNOWN, recursive)


def staged_stdin(kind: str = "csv", limit: int = 512 << 20) -> str:
    """Standard input as a file, at most `limit` bytes."""
    data = sys.stdin.buffer.read(limit + 1)
    if len(data) > limit:
        raise InputError(f"standard input has more than {limit} bytes")
    with tempfile.NamedTemporaryFile("wb", suffix=f".{kind}", delete=False) as f:
        f.write(data)
    return f.name


def detect(path: str, head: bytes | None = None) -> Dialect:
    """Encoding from a mark, else UTF-8 where the first 32 KiB are, else Windows-1252; delimiter by csv's sniffer, else by count."""
    head = (files.head(SparkSession.active(), path) if head is None else head)[: 32 << 10]
    encoding = "utf-8"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "utf-16"
    else:
        try:
            head.decode("utf-8") if len(head) < 32 << 10 else head[:-3].decode("utf-8", "strict")
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4:
                encoding = "windows-1252"
    text = head.decode(encoding, "replace").lstrip("\ufeff")[: 8 << 10]
    if files.suffix(path) == ".tsv":
        return Dialect("\t", encoding)
    try:
        return Dialect(csv.Sniffer().sniff(text, ",\t;|").delimiter, encoding)
    except csv.Error:
        first = text.split("\n", 1)[0]
        best = max(",\t;|", key=first.count)
        return Dialect(best, encoding, 0.45) if first.count(best) else Dialect(",", encoding, 0.2)


def _header(head: bytes, delimiter: str, encoding: str) -> tuple[list[str], int]:
    """The names of the first record that isn't empty, and the number of its first line."""
    text = head.decode({"windows-1252": "cp1252"}.get(encoding, encoding), "replace").lstrip("\ufeff")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    line = 1
    for names in reader:
        if names:
            return names, line
        line = reader.line_num + 1
    return [], line


def _order(parquet: bool = False) -> Column:
    return F.struct(F.col("_metadata.row_index").alias("a"), F.lit(0).cast("long").alias("b")) if parquet else F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b"))


def read(spark: SparkSession, path: str, index: int = 0, delimiter: str | None = None, encoding: str | None = None, headers: str = "none", trim: bool = True, source_column: str | None = None, source_path: bool = False, beginning: bool = False) -> DataFrame:
    """One file as text columns with the hidden columns `_file`, `_ord`, `_bad`; beginning: of text, the first split only."""
    suffix, no_bad = files.suffix(path), F.lit(None).cast(_BAD)
    mark = lambda when, reason, raw: F.when(when, F.struct(F.col("line"), reason.alias("reason"), raw.alias("raw")).cast(_BAD))
    by_line = F.struct(F.lit(0).cast("long").alias("a"), F.col("line").alias("b"))
    if suffix == ".parquet":
        raw = spark.read.parquet(path)
        cells = [(X.text(raw, c), c) for c in raw.columns]
        df, order, bad = raw, _order(True), no_bad
    elif suffix in LINES:
        lines = delimited.numbered(spark, path, beginning).where(F.trim("value") != "").withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
        df = lines.withColumn("_map", F.from_json("value", "map<string,string>"))
        names = [r[0] for r in _keys_in_order(df)]
        cells = [(F.coalesce(F.try_element_at("_map", F.lit(n)), F.lit("")), n) for n in names]
        kind = F.when(F.try_parse_json("value").isNull(), NOT_JSON).otherwise(NOT_OBJECT)
        order, bad = by_line, mark(F.col("_map").isNull(), kind, F.col("value"))
    elif suffix == ".xlsx":
        from .xlsx import workbook

        df = workbook(spark, path, None)
        cells = [(F.coalesce(F.col(X.quoted(c)), F.lit("")), c) for c in df.columns if c != "_row"]
        order, bad = F.struct(F.lit(0).cast("long").alias("a"), F.col("_row").alias("b")), no_bad
    else:
        head = files.head(spark, path, HEAD)
        d = detect(path, head)
        delimiter, encoding = delimiter or d.delimiter, encoding or d.encoding
        if encoding.lower() in ("latin-1", "latin1"):
            encoding = "iso-8859-1"
        wide = encoding.lower().startswith("utf-16")
        names, first = _header(files.whole_head(spark, path, HEAD) if wide else head, delimiter, encoding)
        if not names:
            schema = T.StructType([T.StructField("_file", T.IntegerType()), T.StructField("_ord", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), T.StructField("_bad", T.StructType([T.StructField("line", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("raw", T.StringType())]))])
            return spark.createDataFrame([], schema)
        fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
        cells = [(F.coalesce(F.col(f"c{i}"), F.lit("")), n) for i, n in enumerate(names)]
        if wide:
            # wide characters can't be cut into lines by bytes: one task
            fields.append(T.StructField("_corrupt", T.StringType()))
            df = spark.read.csv(path, schema=T.StructType(fields), header=True, enforceSchema=True, sep=delimiter, quote='"', escape='"', multiLine=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
            # a scan must not be asked for the malformed record alone, so the mark reads the first cell too
            raw = F.concat("_corrupt", F.substring(F.coalesce("c0", F.lit("")), 1, 0))
            order, bad = _order(), F.when(F.col("_corrupt").isNotNull(), F.struct(F.lit(None).cast("long").alias("line"), F.lit(RAGGED).alias("reason"), raw.alias("raw")).cast(_BAD))
        else:
            feed = "\n" if b"\n" in head or b"\r" not in head else "\r"
            found = delimited.records(spark, path, delimiter, encoding, feed, beginning).where(F.col("line") != first)
            parsed = F.from_csv("text", ", ".join(f"{f.name} string" for f in fields), {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names) + 1))})
            df = found.withColumn("_cells", parsed).select("line", "text", "cells", "reason", "_cells.*")
            reason = F.coalesce("reason", F.when(F.col("cells") != len(names), RAGGED))
            order, bad = by_line, mark(reason.isNotNull(), reason, F.col("text"))
    last = {header(n, headers): c for c, n in cells}
    out = [(X.strip(c) if trim else c).alias(n) for n, c in last.items()]
    if source_column:
        out.append(F.lit(path if source_path else files.base(path)).alias(source_column))
    return df.select(*out, F.lit(index).alias("_file"), order.alias("_ord"), bad.alias("_bad"))


def _keys_in_order(parsed: DataFrame) -> list:
    """Keys of all objects by where they are first met."""
    keys = parsed.where("_map is not null").select(F.col("line").alias("o"), F.posexplode(F.json_object_keys("value")).alias("p", "k"))
    return keys.groupBy("k").agg(F.min(F.struct("o", "p")).alias("o")).orderBy("o").select("k").collect()


def deeper(value: Column, depth: int) -> Column:
    """True if a value in a JSON text is inside more than `depth` objects and lists. Texts that open no more brackets aren't gone through."""
    # escapes go first, so that what is left of a string has no quote inside
    bare = F.regexp_replace(F.regexp_replace(value, r"(?s)\\.", ""), '"[^"]*"?', "0")
    bare = F.regexp_replace(bare, r"\{\s*\}|\[\s*\]", "")  # what is empty has no value inside
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "")
    now = lambda s, x: s["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
    top = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda s, x: F.struct(now(s, x).alias("now"), F.greatest(s["top"], now(s, x)).alias("top")), lambda s: s["top"])
    opening = F.length(F.regexp_replace(value, r"[^\[{]+", ""))
    return F.when(opening > depth, top > depth).otherwise(False)


def openable(spark: SparkSession, path: str, limits: Limits) -> None:
    """Raises if a file is larger, deeper or more when unpacked than the limits say; before any of it is parsed."""
    if limits.file_bytes is not None and files.length(spark, path) > limits.file_bytes:
        raise InputError(f"{path} has more than {limits.file_bytes} bytes")
    kind = files.suffix(path)
    if kind in LINES and limits.json_depth is not None:
        line = delimited.numbered(spark, path).where(deeper(F.col("value"), limits.json_depth)).agg(F.min("line")).first()[0]
        if line is not None:
            raise InputError(f"{path} has JSON of more than {limits.json_depth} levels; first in line {line}")
    if kind == ".xlsx" and limits.unpacked_bytes is not None:
        from .xlsx import unpacked

        if unpacked(spark, path) > limits.unpacked_bytes:
            raise InputError(f"{path} unpacks to more than {limits.unpacked_bytes} bytes")


def admitted(df: DataFrame, path: str, limits: Limits) -> DataFrame:
    """df, if its rows, columns and cells keep to the limits; one aggregate over it."""
    names = [c for c in df.columns if c not in HIDDEN]
    if limits.columns is not None and len(names) > limits.columns:
        raise InputError(f"{path} has more than {limits.columns} columns")
    if limits.rows is None and limits.cell_bytes is None:
        return df
    widest = F.greatest(*[F.octet_length(X.quoted(c)) for c in names], F.lit(0)) if names else F.lit(0)
    rows, cell = df.agg(F.count("*"), F.max(widest)).first()
    if limits.rows is not None and rows > limits.rows:
        raise InputError(f"{path} has more than {limits.rows} rows")
    if limits.cell_bytes is not None and (cell or 0) > limits.cell_bytes:
        raise InputError(f"{path} has a cell of more than {limits.cell_bytes} bytes")
    return df


def judged(df: DataFrame, policy: str = "fail", json_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, bad rows). fail: raises if there are any; warn: keeps them padded or cut (bad JSON goes); quarantine: takes them out."""
    bad = df.where("_bad is not null").select("_file", "_ord", "_bad.line", "_bad.reason", F.substring("_bad.raw", 1, 4096).alias("raw"))
    if policy == "fail":
        n, first = bad.agg(F.count("*"), F.min(F.struct("_ord", "line", "reason"))).first()
        if n:
            raise InputError(f"{n} rows don't fit the header; first in line {first['line']}: {first['reason']}")
        return df, bad
    keep_bad = policy == "warn" and not json_lines
    return (df if keep_bad else df.where("_bad is null")), bad


def read_all(spark: SparkSession, paths: Sequence[str], policy: str = "fail", mode: str = "union", limits: Limits | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(rows of all files by column name, bad rows)."""
    from ..operators.project import union

    good, bad = [], []
    for i, p in enumerate(paths):
        if limits:
            openable(spark, p, limits)
        df = read(spark, p, i, **options)
        df = admitted(df, p, limits) if limits else df
        g, b = judged(df, policy, files.suffix(p) in LINES)
        good.append(g.drop("_bad"))
        bad.append(b)
    return union(good, mode), reduce(DataFrame.unionByName, bad)


#: Types that a column's texts are tried as, from narrow to wide, and the form that their texts have.
_TYPES = {
    "int": r"^[+-]?\d+$", "bigint": r"^[+-]?\d+$", "decimal(38,0)": r"^[+-]?\d+$", "double": r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$",
    "date": r"^\d{4}-\d\d-\d\d$", "timestamp_ntz": r"^\d{4}-\d\d?-\d\d?[ T]\d\d?:\d\d?.*$", "boolean": "(?i)^(true|false)$",
}


def typed(df: DataFrame) -> DataFrame:
    """Text columns as the first type that all their cells have; blank cells are null. One pass over the table finds the types."""
    names = [c for c in df.columns if c not in HIDDEN]
    if not names:
        return df
    cell = lambda c: F.nullif(F.trim(X.quoted(c)), F.lit(""))
    fits = [F.bool_and(cell(c).isNull() | cell(c).rlike(form) & cell(c).try_cast(t).isNotNull()).alias(f"{i}_{k}") for i, c in enumerate(names) for k, (t, form) in enumerate(_TYPES.items())]
    found = df.agg(*fits, *[F.count(cell(c)).alias(f"{i}_n") for i, c in enumerate(names)]).first()
    kinds = [next((t for k, t in enumerate(_TYPES) if found[f"{i}_n"] and found[f"{i}_{k}"]), None) for i in range(len(names))]
    return df.select(*[(F.nullif(F.col(X.quoted(c)), F.lit("")) if t is None else cell(c).try_cast(t)).alias(c) for c, t in zip(names, kinds, strict=True)])


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]
