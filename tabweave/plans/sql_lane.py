"""Read-only SQL over named inputs: `input_0`, `input_1`, ...

Spark's own parser decides what a statement is; only queries pass, files can't be named
in it, results are bounded, and a statement can be given a time limit. What a query calls
and reads is judged by the nodes of its plans, not by its text: names that are made from
strings, relations of more than one part and functions that run methods of the JVM are
refused in the parsed plan, and the analysed plan may hold no such call by any other way.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions import text as X


class SqlError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: Functions that run methods of the JVM.
_METHODS = ("reflect", "java_method", "try_reflect")
#: Nodes of names that are only known once they are computed.
_COMPUTED_NAMES = ("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier")
#: Expressions that run methods of the JVM.
_CALLS = ("CallMethodViaReflection", "TryReflect")


def _nodes(plan) -> Iterator[dict]:
    """The plan's operators and expressions, those of subqueries included."""
    todo = [json.loads(plan.toJSON())]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if "class" in x:
                yield x | {"class": x["class"].rpartition(".")[2]}
            todo += x.values()
        elif isinstance(x, list):
            todo += x


def _parts(names: str) -> list[str]:
    """The parts of a name as a plan's JSON has them."""
    return [p.strip() for p in names.strip("[]").split(",")]


def _admitted(parsed) -> None:
    for x in _nodes(parsed):
        if x["class"] in _COMPUTED_NAMES:
            raise SqlError("read_only_required", "names made from strings are not admitted")
        if x["class"] == "UnresolvedFunction" and _parts(x.get("nameParts", ""))[-1].lower() in _METHODS:
            raise SqlError("read_only_required", "functions that run methods of the JVM are not admitted")
        if x["class"] == "UnresolvedRelation" and len(_parts(x["multipartIdentifier"])) > 1:
            raise SqlError("sql_error", f"TABLE_OR_VIEW_NOT_FOUND: {x['multipartIdentifier']}; only the inputs can be read")


@dataclass
class Report:
    query_sha256: str
    views: dict[str, dict[str, str]]
    columns: dict[str, str] = field(default_factory=dict)
    rows: int | None = None


def statement(spark: SparkSession, query: str) -> str:
    """The one query of the text without its closing semicolon; raises SqlError for all else."""
    text = query.strip()
    if not text:
        raise SqlError("empty_query", "the query is empty")
    if _ends_open(text) is None:
        raise SqlError("invalid_query", "a quote or comment isn't closed")
    if _ends_open(text):
        raise SqlError("multiple_statements", "one statement only")
    text = text.rstrip().removesuffix(";").rstrip()
    first = text.lstrip("( \n\t").split(None, 1)
    if not first or first[0].split("(")[0].lower() not in ("select", "with", "values", "from", "table"):
        raise SqlError("read_only_required", "only queries are admitted")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise SqlError("invalid_query", str(e).splitlines()[0]) from e
    names = [plan.getClass().getName(), *[plan.children().apply(i).getClass().getName() for i in range(plan.children().size())]]
    if any("Command" in n or "Insert" in n or "Delete" in n or "Drop" in n or "MergeInto" in n or "Update" in n for n in names):
        raise SqlError("read_only_required", "only queries are admitted")
    _admitted(plan)
    return text


def _ends_open(text: str) -> bool | None:
    """None: a quote or comment stays open; True: something follows a semicolon; False: one statement."""
    i, ended = 0, False
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if two == "--":
            j = text.find("\n", i)
            i = len(text) if j < 0 else j
        elif two == "/*":
            j = text.find("*/", i + 2)
            if j < 0:
                return None
            i = j + 2
        elif c in "'\"`":
            ended_before, j = ended, i + 1
            while j < len(text) and not (text[j] == c and text[j : j + 2] != c * 2):
                j += 2 if text[j] == c or text[j] == "\\" and c != "`" else 1
            if j >= len(text):
                return None
            if ended_before:
                return True
            i = j + 1
        else:
            if ended and not c.isspace():
                return True
            ended = ended or c == ";"
            i += 1
    return False


def query(inputs: Sequence[DataFrame], text: str, as_text: bool = True) -> tuple[DataFrame, Report]:
    """The query's result, lazily, and a report; `collected` brings it to the driver within bounds."""
    spark = inputs[0].sparkSession
    for i, df in enumerate(inputs):
        df.createOrReplaceTempView(f"input_{i}")
    checked = statement(spark, text)
    out = _sql(spark, checked)
    report = Report(hashlib.sha256(checked.encode()).hexdigest(), {f"input_{i}": dict(d.dtypes) for i, d in enumerate(inputs)}, dict(out.dtypes))
    return (out.select(*[X.text(out, c).alias(c) for c in out.columns]) if as_text else out), report


def _sql(spark: SparkSession, text: str) -> DataFrame:
    try:
        out = spark.sql(text)
    except AnalysisException as e:
        raise SqlError("sql_error", str(e).splitlines()[0]) from e
    if any(x["class"] in _CALLS for x in _nodes(out._jdf.queryExecution().analyzed())):
        raise SqlError("read_only_required", "functions that run methods of the JVM are not admitted")
    return out


def collected(df: DataFrame, max_rows: int = 100_000, max_cell_bytes: int = 1 << 20, timeout: float | None = None, cancel: threading.Event | None = None) -> list:
    """The rows; SqlError result_row_limit, result_cell_limit, query_timeout or query_cancelled otherwise."""
    sc, found = df.sparkSession.sparkContext, {}
    group = f"sql-{id(found)}"

    def run() -> None:
        sc.setJobGroup(group, "sql lane", interruptOnCancel=True)
        try:
            found["rows"] = df.limit(max_rows + 1).collect()
        except Exception as e:  # handed to the caller below
            found["error"] = e

    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    waited, step = 0.0, 0.05
    while worker.is_alive():
        worker.join(step)
        waited += step
        late, stop = timeout is not None and waited >= timeout, cancel is not None and cancel.is_set()
        if worker.is_alive() and (late or stop):
            sc.cancelJobGroup(group)
            worker.join(10)
            raise SqlError("query_timeout" if late else "query_cancelled", "the query was stopped")
    if "error" in found:
        raise SqlError("sql_error", str(found["error"]).splitlines()[0])
    if len(found["rows"]) > max_rows:
        raise SqlError("result_row_limit", f"more than {max_rows} rows")
    if any(isinstance(v, str) and len(v.encode()) > max_cell_bytes for r in found["rows"] for v in r):
        raise SqlError("result_cell_limit", f"a cell has more than {max_cell_bytes} bytes")
    return found["rows"]
