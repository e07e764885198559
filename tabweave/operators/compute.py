"""Computed columns: an arithmetic expression over `{column}` references, as a Column.

The expression is read with Python's own grammar and only the forms below are
admitted; nothing is evaluated. Numbers are doubles, texts are texts, and which of
both a reference is depends on the cell. What can't be worked out gives a blank.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass
class Value:
    """A value that is a number where `number` isn't null, else a text; both null: no value."""

    number: Column
    text: Column

    def any_text(self) -> Column:
        return F.coalesce(X.number_text(self.number), self.text)




def _num(c: Column) -> Value:
    return Value(c, F.lit(None).cast("string"))


def _txt(c: Column) -> Value:
    return Value(F.lit(None).cast("double"), c)


def _binary(op: ast.operator, a: Value, b: Value) -> Value:
    x, y = a.number, b.number
    if isinstance(op, ast.Add):
        return Value(x + y, F.concat(a.text, b.text))
    plain: dict[type, Callable[[], Column]] = {
        ast.Sub: lambda: x - y,
        ast.Mult: lambda: x * y,
        ast.Div: lambda: F.when(y != 0, x / y),
        ast.FloorDiv: lambda: F.when(y != 0, F.floor(x / y).cast("double")),
        ast.Pow: lambda: F.pow(x, y),
    }
    if type(op) not in plain:
        raise ValueError(f"{type(op).__name__} is not supported in a computed column")
    return _num(plain[type(op)]())


def _call(name: str, args: list[Value]) -> Value:
    numbers = [a.number for a in args]
    if name in ("min", "max") and len(args) > 1:
        least = F.least if name == "min" else F.greatest
        known = numbers[0].isNotNull()
        for n in numbers[1:]:
            known = known & n.isNotNull()
        return _num(F.when(known, least(*numbers)))
    one: dict[str, Callable[[], Value]] = {
        "abs": lambda: _num(F.abs(numbers[0])),
        "round": lambda: _num(F.bround(numbers[0], 0)),
        "len": lambda: _num(F.length(args[0].text).cast("double")),
        "str": lambda: _txt(args[0].any_text()),
        "int": lambda: _num(F.when(numbers[0] >= 0, F.floor(numbers[0])).otherwise(F.ceil(numbers[0])).cast("double")),
        "float": lambda: _num(F.coalesce(numbers[0], X.as_number(args[0].text))),
    }
    if name == "pow" and len(args) == 2:
        return _num(F.pow(*numbers))
    if name == "round" and len(args) == 2:
        return _num(F.when(numbers[1].isNotNull(), F.bround(numbers[0] * F.pow(F.lit(10.0), numbers[1]), 0) / F.pow(F.lit(10.0), numbers[1])))
    if name not in one or len(args) != 1:
        raise ValueError(f"{name}() is not supported in a computed column")
    return one[name]()


def compiled(expression: str, cell: Callable[[str], Column]) -> Column:
    """The expression's result as text; `cell` gives a reference's text."""
    names: list[str] = []

    def reference(m: re.Match) -> str:
        names.append(m[1])
        return f" _r{len(names) - 1} "

    tree = ast.parse(re.sub(r"\{([^}]+)\}", reference, expression).strip(), mode="eval")

    def walk(n: ast.AST) -> Value:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return _num(F.lit(float(n.value)))
        if isinstance(n, ast.Constant) and isinstance(n.value, str):
            return _txt(F.lit(n.value))
        if isinstance(n, ast.Name) and re.fullmatch(r"_r\d+", n.id):
            c = cell(names[int(n.id[2:])])
            number = X.as_number(c)
            return Value(number, F.when(number.isNull(), c))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            v = walk(n.operand).number
            return _num(-v if isinstance(n.op, ast.USub) else v)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mult):
            # a text is repeated by a whole number that the expression itself names, not by a cell
            for text, times in ((n.left, n.right), (n.right, n.left)):
                if isinstance(times, ast.Constant) and type(times.value) is int:
                    v = walk(text)
                    return Value(v.number * float(times.value), F.repeat(v.text, F.lit(times.value)))
        if isinstance(n, ast.BinOp):
            return _binary(n.op, walk(n.left), walk(n.right))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            return _call(n.func.id, [walk(a) for a in n.args])
        raise ValueError(f"{type(n).__name__} is not supported in a computed column")

    return F.coalesce(walk(tree.body).any_text(), F.lit(""))


def column(expression: str, cell: Callable[[str], Column]) -> Column:
    """As `compiled`; an expression that isn't admitted gives blanks."""
    try:
        return compiled(expression, cell)
    except (SyntaxError, ValueError, RecursionError):
        return F.lit("")
