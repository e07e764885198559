"""Records of delimited text, read by many tasks whatever line breaks their cells hold.

A record ends at a line break outside quotes. What a stretch of text does to that state
is a function of two values (outside, inside), and such functions compose, so each split
of a file is looked at by itself first: how many lines it has, and for either state at
its beginning the state at its end and whether a record ends in it. A split's own state,
first line and open record follow from those before it: a row a split, put together on
the driver. Then every split cuts its lines into records. A record that goes on into
other splits is put together from its fragments, as many as the splits it touches.

The state is an automaton's over cells, not a count of quotes: a quote inside an unquoted
cell is an ordinary character, a doubled quote inside a quoted one stands for itself, and
text after a closing quote belongs to the cell up to the next delimiter.

Splits and lines come from Spark's text reader. Lines end with `feed`; a carriage return
before a line feed goes with it. Encodings must hold feed, quote and delimiter as single
bytes of their own (UTF-8, Windows and ISO code pages; not UTF-16).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLIT = "block long, n long, ends array<boolean>, cuts array<boolean>"
_RECORD = "owner long, line long, whole boolean, text binary, cells int"
#: Why a record is bad.
OPEN, ENCODING = "a quote is never closed", "not valid in the file's encoding"
_CODECS = {"windows-1252": "cp1252", "iso-8859-1": "latin-1", "us-ascii": "ascii"}


def step(line: bytes, inside: bool, delimiter: bytes) -> tuple[bool, int]:
    """(state after the line, delimiters between cells in it)."""
    at, cells = 0, 0
    while True:
        if inside:
            close = line.find(b'"', at)
            if close < 0:
                return True, cells
            if line[close + 1 : close + 2] == b'"':
                at = close + 2
                continue
            inside, at = False, close + 1
        elif line[at : at + 1] == b'"':
            inside, at = True, at + 1
            continue
        to = line.find(delimiter, at)
        if to < 0:
            return False, cells
        cells, at = cells + 1, to + len(delimiter)


def _lines(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """(block, value): the file's lines in order within their split, as bytes."""
    return spark.read.option("lineSep", feed).text(path).select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def splits(lines: DataFrame, delimiter: bytes) -> list[dict]:
    """A dict a split, in order: block, n, and by the state at its beginning the state at its end and whether a record ends in it."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, ends, cuts, out = None, 0, [], [], []
        for b in batches:
            for own, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own != block:
                    if block is not None:
                        out.append((block, n, ends, cuts))
                    block, n, ends, cuts = own, 0, [False, True], [False, False]
                n += 1
                if value is not None:
                    ends = [step(value, s, delimiter)[0] for s in ends]
                cuts = [c or not s for c, s in zip(cuts, ends, strict=True)]
        if block is not None:
            out.append((block, n, ends, cuts))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["block", "n", "ends", "cuts"])

    # only lines with quotes travel
    quoted = F.when(F.col("value").cast("string").contains('"'), F.col("value"))
    return [r.asDict() for r in lines.select("block", quoted.alias("value")).mapInArrow(seen, _SPLIT).orderBy("block").collect()]


def starts(found: list[dict]) -> tuple[list[tuple[int, bool, int, int]], int | None]:
    """A row a split: its block, whether it begins inside quotes, the number of its first line, the block in which the record
    open at its beginning began; and the block in which a record begins that the file's end leaves open."""
    out, inside, line, owner = [], False, 1, -1
    for s in found:
        out.append((s["block"], inside, line, owner))
        owner = s["block"] if s["cuts"][inside] or not inside else owner
        line += s["n"]
        inside = s["ends"][inside]
    return out, owner if inside else None


def _cutter(delimiter: bytes, feed: bytes):
    """Cuts (block, inside, first, owner, value) rows into records and fragments of records."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, line, owner = None, False, 0, -1
        begun, held, cells, out = 0, [], 0, []

        def close(whole: bool) -> None:
            nonlocal held, cells
            if held:
                out.append((owner, begun, whole, feed.join(held), cells))
            held, cells = [], 0

        for b in batches:
            for own, was, first, of, value in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if own != block:
                    close(False)
                    block, inside, line, owner, begun = own, was, first, of, first
                if not inside:
                    begun, owner = line, block
                    if value in (b"", b"\r"):
                        line += 1
                        continue
                if inside or b'"' in value:
                    inside, more = step(value, inside, delimiter)
                else:
                    more = value.count(delimiter)
                held.append(value)
                cells, line = cells + more, line + 1
                if not inside:
                    close(owner == block)
            yield _batch(out)
            out = []
        close(False)
        yield _batch(out)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("owner", pa.int64()), ("line", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary()), ("cells", pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", feed: str = "\n", beginning: bool = False) -> DataFrame:
    """(line, text, cells, reason): the file's records, the header's too, each with the number of its first line, the cells
    it has and what is wrong with its quotes or bytes (null: nothing). Empty lines are no records. beginning: those of the
    first split only, without a look at the others."""
    sep, lines = delimiter.encode("latin-1"), _lines(spark, path, feed)
    # a file of one split needs no look ahead
    one = beginning or lines.rdd.getNumPartitions() <= 1
    begin, last = ([(0, False, 1, -1)], None) if one else starts(splits(lines, sep))
    # a row of 32 bytes a split
    table = F.broadcast(spark.createDataFrame(begin, "block long, inside boolean, first long, owner long"))
    placed = lines.join(table, "block").select("block", "inside", "first", "owner", "value")
    found = placed.mapInArrow(_cutter(sep, feed.encode()), _RECORD).withColumn("cells", F.col("cells") + 1)
    whole = found.select("line", "text", "cells", (~F.col("whole")).alias("open"))
    if not one:
        parts = found.where("not whole").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("line", "text", "cells"))).alias("p"))
        rest = F.slice("p", 2, F.size("p"))
        first = F.col("p")[0]
        text = F.aggregate(rest, first["text"], lambda a, x: F.concat(a, F.lit(feed.encode()), x["text"]))
        glued = parts.select(first["line"].alias("line"), text.alias("text"), F.aggregate(rest, first["cells"], lambda a, x: a + x["cells"] - 1).alias("cells"), (F.col("owner") == F.lit(-1 if last is None else last)).alias("open"))
        whole = whole.where("not open").unionByName(glued)
    return _decoded(whole, _CODECS.get(encoding.lower(), encoding.lower()))


def _decoded(df: DataFrame, codec: str) -> DataFrame:
    if codec in ("utf-8", "utf8", "utf-8-sig"):
        raw = F.col("text").cast("string")
        df = df.withColumns({"bad": ~F.is_valid_utf8(raw), "text": F.make_valid_utf8(raw)})
    else:

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, bad = [], []
                for raw in b.column("text").to_pylist():
                    try:
                        texts.append(raw.decode(codec))
                        bad.append(False)
                    except UnicodeDecodeError:
                        texts.append(raw.decode(codec, "replace"))
                        bad.append(True)
                yield pa.RecordBatch.from_arrays([b.column("line"), pa.array(texts, pa.string()), b.column("cells"), b.column("open"), pa.array(bad, pa.bool_())], names=["line", "text", "cells", "open", "bad"])

        df = df.mapInArrow(decode, "line long, text string, cells int, open boolean, bad boolean")
    reason = F.when(F.col("open"), OPEN).when(F.col("bad"), ENCODING)
    return df.select("line", F.regexp_replace("text", r"\r$", "").alias("text"), "cells", reason.alias("reason"))


def numbered(spark: SparkSession, path: str, beginning: bool = False) -> DataFrame:
    """(line, value): lines that are records of their own, as JSON Lines are, with their numbers."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    if beginning or lines.rdd.getNumPartitions() <= 1:
        return lines.where("block = 0").select((F.col("at") + 1).alias("line"), "value")
    found = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("low")).orderBy("block").collect()
    begin, line = [], 1
    for r in found:
        begin.append((r["block"], line - r["low"]))
        line += r["n"]
    # a row a split
    return lines.join(F.broadcast(spark.createDataFrame(begin, "block long, shift long")), "block").select((F.col("at") + F.col("shift")).alias("line"), "value")
