"""Writers: one delimited, JSON Lines, Parquet or workbook file, put in place whole.

A folder target (no file suffix) is written by all tasks at once; that is the form for
large results. A single file is for results that one task can write. `write_folder` writes
to any file system that Spark can: all tasks write into a folder beside the target, which
takes the target's place when the job is done; a job that fails leaves the old one.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import xlsx

ENCODINGS = {"latin-1": "iso-8859-1", "cp1252": "windows-1252"}


class OutputError(ValueError):
    """An output that can't be written under the given rules."""


def as_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[X.text(df, c).alias(c) for c in columns])


def _line(columns: Sequence[str], delimiter: str, quoting: str) -> Column:
    """A record as one text; quoting minimal, all (nonnumeric is the same: cells are text) or none."""

    def cell(c: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        if quoting == "none":
            return c
        if quoting in ("all", "nonnumeric"):
            return quoted
        special = reduce(lambda a, b: a | b, [c.contains(x) for x in (delimiter, '"', "\n", "\r")])
        return F.when(special | ((c == "") & F.lit(len(columns) == 1)), quoted).otherwise(c)

    return F.concat_ws(delimiter, *[cell(F.col(X.quoted(c))) for c in columns])


def write(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence[Column] = (), delimiter: str = ",", encoding: str = "utf-8", quoting: str = "minimal", header: bool = True, line_ending: str = "\n", collision: str = "replace") -> str:
    """Writes df's columns as text to `path` and gives the path; collision replace, fail or backup."""
    columns = list(columns or df.columns)
    if Path(path).suffix.lower() == ".tsv" and delimiter == ",":
        delimiter = "\t"
    if os.path.exists(path) and collision == "fail":
        raise OutputError(f"{path} exists")
    out = as_texts(df.orderBy(*order) if order else df, columns)
    suffix, target = Path(path).suffix.lower(), Path(path).absolute()
    target.parent.mkdir(parents=True, exist_ok=True)
    work = Path(tempfile.mkdtemp(prefix=".write-", dir=target.parent))
    try:
        if suffix == ".xlsx":
            xlsx.write(str(work / "file"), columns, (list(r) for r in out.toLocalIterator()))
        else:
            # a sorted result is sorted by many tasks; its ranges are then read one after the other
            single = out.coalesce(1) if suffix and (not order or suffix == ".parquet") else out
            w = single.write.mode("overwrite")
            if suffix == ".parquet":
                w.parquet(str(work / "parts"))
            elif suffix in (".jsonl", ".ndjson"):
                w.json(str(work / "parts"))
            else:
                lines = single.select(_line(columns, delimiter, quoting).alias("value"))
                lines.write.mode("overwrite").text(str(work / "parts"), lineSep=line_ending)
            if suffix:
                _joined(work, columns, suffix, delimiter, encoding, quoting, header, line_ending)
        _commit(work / ("file" if suffix else "parts"), target, collision)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return str(target)


def write_folder(df: DataFrame, uri: str, kind: str = "csv", columns: Sequence[str] | None = None, collision: str = "replace", delimiter: str = ",") -> str:
    """df's columns as a folder of csv (a header in each part), jsonl or parquet parts; collision replace, fail or backup."""
    columns = list(columns or df.columns)
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(path) and collision == "fail":
        raise OutputError(f"{uri} exists")
    stamp = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".write-{stamp}-{path.getName()}")
    w = (df.select(*[F.col(X.quoted(c)) for c in columns]) if kind == "parquet" else as_texts(df, columns)).write
    try:
        if kind == "parquet":
            w.parquet(made.toString())
        elif kind == "jsonl":
            w.option("ignoreNullFields", "false").json(made.toString())
        else:
            w.csv(made.toString(), sep=delimiter, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        if fs.exists(path):
            if collision == "backup":
                fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"{path.getName()}.{stamp}.bak"))
            else:
                fs.delete(path, True)
        if not fs.rename(made, path):
            raise OutputError(f"{uri} can't be put in place")
    finally:
        if fs.exists(made):
            fs.delete(made, True)
    return uri


def _joined(work: Path, columns: Sequence[str], suffix: str, delimiter: str, encoding: str, quoting: str, header: bool, line_ending: str) -> None:
    """The part files in a row, with the header, in the target's encoding."""
    parts = sorted(p for p in (work / "parts").iterdir() if p.name.startswith("part-"))
    if suffix == ".parquet":
        os.replace(parts[0], work / "file")
        return
    with (work / "file").open("wb") as out:
        if header and suffix not in (".jsonl", ".ndjson"):
            cells = [f'"{c.replace(chr(34), chr(34) * 2)}"' if quoting in ("all", "nonnumeric") or quoting == "minimal" and any(x in c for x in (delimiter, '"', "\n", "\r")) else c for c in columns]
            out.write((delimiter.join(cells) + line_ending).encode(encoding))
        for p in parts:
            with p.open("rb") as f:
                if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
                    shutil.copyfileobj(f, out, 1 << 20)
                else:
                    coder = "utf-16-le" if encoding.lower() == "utf-16" and out.tell() else encoding
                    for line in f:
                        out.write(line.decode("utf-8").encode(coder))


def _commit(made: Path, target: Path, collision: str) -> None:
    if target.exists() and collision == "backup":
        os.replace(target, f"{target}.{datetime.now(UTC):%Y%m%dT%H%M%S%f}.bak")
    if made.is_dir() and target.is_dir():
        shutil.rmtree(target)
    os.replace(made, target)


def write_json(path: str, document: dict | list) -> str:
    """A JSON document, put in place whole."""
    target = Path(path).absolute()
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as f:
        json.dump(document, f, indent=2, ensure_ascii=False, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, target)
    return str(target)


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def manifest(output: str, inputs: Sequence[str], config: dict, columns: Sequence[str], stats: dict) -> dict:
    """What a run read, did and wrote."""
    text = json.dumps(config, sort_keys=True, default=str)
    return {
        "format": "run-manifest", "version": 1, "created": datetime.now(UTC).isoformat(),
        "inputs": [{"path": p, "sha256": sha256(p), "bytes": os.path.getsize(p)} for p in inputs if os.path.isfile(p)],
        "output": {"path": output, "sha256": sha256(output) if os.path.isfile(output) else None},
        "config_sha256": hashlib.sha256(text.encode()).hexdigest(), "columns": list(columns), "stats": stats,
    }


def quarantine(bad: DataFrame, path: str, files: Sequence[str], most: int = 10_000) -> str:
    """At most `most` bad rows, first in order, as JSON Lines."""
    rows = bad.orderBy("_file", "_ord").limit(most).collect()
    target = Path(path).absolute()
    text = "".join(json.dumps({"file": files[r["_file"]], "line": r["line"], "reason": r["reason"], "raw": r["raw"]}, ensure_ascii=False) + "\n" for r in rows)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, target)
    return str(target)
