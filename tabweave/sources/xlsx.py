"""Workbooks: the active sheet, unpacked in a task, and a writer for small results."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_BYTES = 1 << 30


def _index(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _unpacked(z: zipfile.ZipFile) -> int:
    """Bytes of all parts as the directory states them; no part is read beyond these."""
    return sum(i.file_size for i in z.infolist())


def unpacked(spark: SparkSession, path: str) -> int:
    """Bytes that a workbook unpacks to, found in a task."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    yield pa.RecordBatch.from_arrays([pa.array([_unpacked(z)], pa.int64())], names=["n"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] or 0


def _sheet(z: zipfile.ZipFile) -> str:
    """Part name of the active sheet."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    view = book.find(f"{_NS}bookViews/{_NS}workbookView")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    rel = book.findall(f"{_NS}sheets/{_NS}sheet")[active].get(_REL)
    for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == rel:
            return "xl/" + r.get("Target").removeprefix("/xl/").removeprefix("xl/")
    raise ValueError("the workbook has no active sheet")


def rows(path: str | io.BytesIO, most: int | None = MOST_BYTES) -> Iterator[list[str]]:
    """Cell texts of the active sheet, row by row; formulas give their cached value."""
    with zipfile.ZipFile(path) as z:
        if most is not None and _unpacked(z) > most:
            raise ValueError(f"the workbook unpacks to more than {most} bytes")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        with z.open(_sheet(z)) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str] = []
                for k, c in enumerate(row.findall(f"{_NS}c")):
                    at = _index(c.get("r")) if c.get("r") else k
                    v, kind = c.find(f"{_NS}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is None or v.text is None:
                        text = ""
                    else:
                        text = shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text
                    out += [""] * (at - len(out)) + [text]
                yield out
                row.clear()


def workbook(spark: SparkSession, path: str, most: int | None = MOST_BYTES) -> DataFrame:
    """The active sheet's rows as texts, with their number `_row`; the first row has the names. One task a workbook."""
    book = spark.read.format("binaryFile").load(path)
    size = book.agg(F.max("length")).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found = enumerate(rows(io.BytesIO(content.as_py()), most))
                while some := list(itertools.islice(found, 2048)):
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([r for _, r in some], pa.list_(pa.string()))], names=["_row", "cells"])

    table = book.select("content").mapInArrow(opened, "_row long, cells array<string>")
    first = table.where("_row = 0").first()
    names = [h or f"column_{i + 1}" for i, h in enumerate(first["cells"] if first else [])]
    cells = {h: F.coalesce(F.get("cells", i), F.lit("")).alias(h) for i, h in enumerate(names)}
    return table.where("_row > 0").select(*cells.values(), (F.col("_row") - 1).alias("_row"))


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write(path: str, columns: Sequence[str], data: Iterator[Sequence[str]], sheet: str = "Data") -> None:
    """One sheet of texts; for results that fit the driver."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    kinds = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kinds}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{kinds}/spreadsheetml/2006/main" xmlns:r="{kinds}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, head + body)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{kinds}/spreadsheetml/2006/main"><sheetData>'.encode())
            f.write(_row(1, columns))
            for i, row in enumerate(data, 2):
                f.write(_row(i, row))
            f.write(b"</sheetData></worksheet>")


def _row(i: int, row: Sequence[str]) -> bytes:
    cells = "".join(f'<c r="{_letters(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for k, v in enumerate(row))
    return f'<row r="{i}">{cells}</row>'.encode()
