"""A small typed expression language over one point, compiled to Spark columns.

    let $x = $value * 2; $x + 1            variables, bound by let
    ($time + '1 day'i, $value ^ 2)         tuples, interval and time literals ('2020-01-01't)
    $value > 3 and not ($value = 7)        and, or, not; = != <> < <= > >=; + - * /; ^ to the right

Operators bind, from loose to tight: or, and, comparisons, + and -, * and /, ^, sign and not.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions import timevector as tv
from tsmill.functions.base import ieee_div
from tsmill.functions.times import flat_micros, micros

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^']|'')*'[ti])|(?P<var>\$[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<op><>|!=|<=|>=|[-+*/^=<>(),;]))")
#: Functions of one number beside those that pipelines have; fixed names.
_MORE = {
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "sin": F.sin, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh,
    "acosh": F.acosh, "atanh": F.atanh,
}
ONE = {**tv.UNARY, **_MORE}
COMPARE = {"=", "!=", "<>", "<", "<=", ">", ">="}


class LambdaError(ValueError):
    """The text is no expression of the language, or its types do not fit."""


@dataclass
class Node:
    """kind: double, bool, time, interval or tuple; of a tuple, column is a list of nodes."""

    kind: str
    column: object


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise LambdaError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str, time: Column, value: Column):
        self.tokens, self.at = tokens(text), 0
        self.names = {"$time": Node("time", time), "$value": Node("double", value)}

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.tokens[self.at][0] not in ("str", "end"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, wanted: str) -> None:
        if not self.take(wanted):
            raise LambdaError(f"expected {wanted!r}, found {self.peek()!r}")

    def whole(self) -> Node:
        while self.take("let"):
            kind, name = self.tokens[self.at]
            if kind != "var":
                raise LambdaError("let needs a $variable")
            if name in ("$time", "$value"):
                raise LambdaError(f"{name} cannot be bound")
            self.at += 1
            self.expect("=")
            bound = self.tuple_or_one()
            self.expect(";")
            self.names[name] = bound
        out = self.tuple_or_one()
        if self.tokens[self.at][0] != "end":
            raise LambdaError(f"unexpected {self.peek()!r}")
        return out

    def tuple_or_one(self) -> Node:
        first = self.either()
        if self.peek() != ",":
            return first
        parts = [first]
        while self.take(","):
            parts.append(self.either())
        return Node("tuple", parts)

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = self.logic(left, self.both(), "or")
        return left

    def both(self) -> Node:
        left = self.comparison()
        while self.take("and"):
            left = self.logic(left, self.comparison(), "and")
        return left

    @staticmethod
    def logic(a: Node, b: Node, op: str) -> Node:
        if a.kind != "bool" or b.kind != "bool":
            raise LambdaError(f"{op} needs conditions")
        # written with when() so that the right side is only looked at if the left leaves it open
        return Node("bool", F.when(a.column, F.lit(True)).otherwise(b.column) if op == "or" else F.when(a.column, b.column).otherwise(F.lit(False)))

    def comparison(self) -> Node:
        left = self.sums()
        while (op := self.peek()) in COMPARE and self.take(op):
            right = self.sums()
            if left.kind == "tuple" and right.kind == "tuple" and op in ("=", "!=", "<>") and len(left.column) == len(right.column):
                same = F.lit(True)
                for a, b in zip(left.column, right.column):
                    same = same & (a.column == b.column)
                left = Node("bool", same if op == "=" else ~same)
                continue
            if left.kind != right.kind or left.kind == "tuple":
                raise LambdaError(f"cannot compare {left.kind} and {right.kind}")
            a, b = left.column, right.column
            left = Node("bool", {"=": lambda: a == b, "!=": lambda: a != b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]())
        return left

    def sums(self) -> Node:
        left = self.products()
        while op := self.take("+", "-"):
            left = self.arithmetic(left, self.products(), op)
        return left

    def products(self) -> Node:
        left = self.powers()
        while op := self.take("*", "/"):
            left = self.arithmetic(left, self.powers(), op)
        return left

    def powers(self) -> Node:
        left = self.signed()
        if self.take("^"):
            return self.arithmetic(left, self.powers(), "^")
        return left

    def signed(self) -> Node:
        if self.take("-"):
            x = self.signed()
            if x.kind not in ("double", "interval"):
                raise LambdaError(f"cannot negate a {x.kind}")
            return Node(x.kind, -x.column)
        if self.take("not"):
            x = self.signed()
            if x.kind != "bool":
                raise LambdaError("not needs a condition")
            return Node("bool", ~x.column)
        return self.atom()

    @staticmethod
    def arithmetic(a: Node, b: Node, op: str) -> Node:
        x, y, kinds = a.column, b.column, (a.kind, b.kind)
        if kinds == ("double", "double"):
            if op == "/":
                return Node("double", ieee_div(x, y))
            return Node("double", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[op]())
        if op in "+-" and kinds == ("time", "interval"):
            return Node("time", x + y if op == "+" else x - y)
        if op == "+" and kinds == ("interval", "time"):
            return Node("time", x + y)
        if op == "-" and kinds == ("time", "time"):
            return Node("interval", x - y)
        if op in "+-" and kinds == ("interval", "interval"):
            return Node("interval", x + y if op == "+" else x - y)
        if op in "*/" and kinds == ("interval", "double"):
            return Node("interval", F.round(x * y if op == "*" else ieee_div(x, y)).cast("long"))
        if op == "*" and kinds == ("double", "interval"):
            return Node("interval", F.round(x * y).cast("long"))
        raise LambdaError(f"cannot compute {a.kind} {op} {b.kind}")

    def atom(self) -> Node:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("double", F.lit(float(text)))
        if kind == "str":
            body = text[1:-2].replace("''", "'")
            return Node("time", micros(F.lit(body))) if text.endswith("t") else Node("interval", F.lit(flat_micros(body)))
        if kind == "var":
            if text not in self.names:
                raise LambdaError(f"unknown variable {text}")
            return self.names[text]
        if text == "(":
            out = self.tuple_or_one()
            self.expect(")")
            return out
        if kind == "name" and text not in ("and", "or", "not", "let"):
            return self.call(text)
        raise LambdaError(f"unexpected {text!r}")

    def call(self, name: str) -> Node:
        if name in ("true", "false") and self.peek() != "(":
            return Node("bool", F.lit(name == "true"))
        self.expect("(")
        args = []
        if not self.take(")"):
            inner = self.tuple_or_one()
            args = inner.column if inner.kind == "tuple" else [inner]
            self.expect(")")
        if any(a.kind != "double" for a in args):
            raise LambdaError(f"{name} takes numbers")
        x = [a.column for a in args]
        if name == "pi" and not x:
            return Node("double", F.lit(math.pi))
        if name in ONE and len(x) == 1:
            return Node("double", ONE[name](x[0]).cast("double"))
        if name == "log" and len(x) == 2:
            return Node("double", ieee_div(tv.ieee_ln(x[0]), tv.ieee_ln(x[1])))
        if name == "atan2" and len(x) == 2:
            return Node("double", F.atan2(x[0], x[1]))
        raise LambdaError(f"unknown function {name} of {len(x)}")


def compile(text: str, time: Column, value: Column) -> tuple[str, Column]:  # noqa: A001
    """(kind, column); a tuple becomes a struct."""
    out = Parser(text, time, value).whole()
    if out.kind == "tuple":
        return "tuple", F.struct(*(n.column.alias(f"_{i}") for i, n in enumerate(out.column)))
    return out.kind, out.column


def point(text: str, time: Column, value: Column) -> Column:
    """struct<ts, val> from an expression that gives a value or (time, value)."""
    out = Parser(text, time, value).whole()
    if out.kind == "double":
        return F.struct(time.alias("ts"), out.column.alias("val"))
    if out.kind == "tuple" and [n.kind for n in out.column] == ["time", "double"]:
        return F.struct(out.column[0].column.alias("ts"), out.column[1].column.alias("val"))
    raise LambdaError("map needs a value or (time, value)")


def _typed(text: str, time, value, kind: str) -> Column:
    got, c = compile(text, micros(time), value if isinstance(value, Column) else F.lit(float(value)))
    if got != kind:
        raise LambdaError(f"the expression gives {got}, not {kind}")
    return c


def bool_lambda(text: str, time, value) -> Column:
    return _typed(text, time, value, "bool")


def f64_lambda(text: str, time, value) -> Column:
    return _typed(text, time, value, "double")


def ttz_lambda(text: str, time, value) -> Column:
    return F.timestamp_micros(_typed(text, time, value, "time"))


def interval_lambda(text: str, time, value) -> Column:
    """Microseconds."""
    return _typed(text, time, value, "interval")


def point_lambda(text: str, time, value) -> Column:
    return point(text, micros(time), value if isinstance(value, Column) else F.lit(float(value)))


def trace_lambda(text: str, time, value) -> Column:
    """The kind of the result and the result, as text."""
    kind, c = compile(text, micros(time), value if isinstance(value, Column) else F.lit(float(value)))
    return F.concat(F.lit(f"{kind}: "), F.to_json(F.struct(c.alias("result"))))
