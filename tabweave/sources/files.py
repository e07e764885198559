"""Names, sizes and first bytes of inputs, through Spark's own readers: any file system that Spark can open."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import col


def plain(uri: str) -> str:
    """A local file's URI as a plain path; other URIs as they are."""
    return re.sub(r"^file:/+", "/", uri)


def suffix(path: str) -> str:
    """The lower-cased extension of the last part, with its dot."""
    name = path.rstrip("/").rpartition("/")[2]
    return f".{name.rpartition('.')[2].lower()}" if "." in name.strip(".") else ""


def base(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def _index(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length) of what Spark's file index finds; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length")


def listed(spark: SparkSession, patterns: Sequence[str], kinds: set[str], recursive: bool = True) -> list[str]:
    """Files of folders, globs and names, each once, in order of the lower-cased path.

    A name that stands for itself is kept as it was given; nothing found is no error.
    """
    found: dict[str, str] = {}
    for p in patterns:
        if p == "-":
            found["-"] = "-"
            continue
        try:
            names = [plain(r["path"]) for r in _index(spark, p, recursive).collect()]
        except AnalysisException:
            continue
        for n in names:
            if suffix(n) in kinds:
                found.setdefault(n, p if len(names) == 1 and suffix(p) in kinds and not re.search(r"[*?\[{]", p) else n)
    return sorted(found.values(), key=str.lower)


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    return int(_index(spark, path).agg(F.sum("length")).first()[0] or 0)


def head(spark: SparkSession, path: str, size: int = 32 << 10, lines: int = 64, more: int = 16 << 10) -> bytes:
    """The beginning: `size` bytes of the first line, `more` of each of the next ones."""
    text = spark.read.option("lineSep", "\n").text(path)
    cut = lambda n: text.select(F.substring(col("value").cast("binary"), 1, n).alias("value"))
    # taken from the first splits on, as many as are needed
    return b"\n".join([bytes(r["value"]) for r in cut(size).take(1)] + [bytes(r["value"]) for r in cut(more).take(lines)[1:]])


def whole_head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file that can't be cut into lines by bytes."""
    return bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("b")).first()["b"])
