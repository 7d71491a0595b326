"""Spark columns from predicates and arithmetic, with the dialect's types checked before Spark sees them."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch
from ..plans.syntax import Binary, Cnf, Comparison, Expression, Negative, Operand
from ..types import Kind, comparable, kind_of

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Bound:
    """A column with its type in the dialect; ``stored`` and ``type`` are what the table holds, if this is a column of one."""

    value: Column
    kind: Kind
    stored: Column | None = None
    type: T.DataType | None = None

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.DateType, T.TimestampType, T.TimestampNTZType))


Resolve = Callable[[str], Bound]


def bind_column(column: Column, data_type: T.DataType) -> Bound:
    """A table's column as the dialect sees it: times as strings of their day, other numbers as Int or Double."""
    kind = kind_of(data_type)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.date_format(column, "yyyy-MM-dd")
    elif kind is Kind.DOUBLE and not isinstance(data_type, T.DoubleType):
        value = column.cast("double")
    else:
        value = column
    return Bound(value, kind, column, data_type)


def bind_operand(operand: Operand, resolve: Resolve) -> Bound:
    if operand.kind == "name":
        return resolve(operand.value)
    if operand.kind == "string":
        return Bound(F.lit(operand.value), Kind.STRING)
    if operand.kind == "float":
        return Bound(F.lit(float(operand.value)), Kind.DOUBLE)
    return Bound(F.lit(int(operand.value)), Kind.INT)


def _by_day(column: Bound, op: str, literal: str) -> Column | None:
    """A comparison of a time's day with a day, on the time itself, so that scans can skip by it; None if the text is no day."""
    try:
        day = datetime.date.fromisoformat(literal) if _DAY.fullmatch(literal) else None
        after = day and day + datetime.timedelta(days=1)
    except (ValueError, OverflowError):
        return None
    if not day:
        return None
    at = lambda d: F.lit(d.isoformat()).cast(column.type)
    if op == "<":
        return column.stored < at(day)
    if op == ">":
        return column.stored >= at(after)
    return (column.stored >= at(day)) & (column.stored < at(after))


def _compare(left: Column, op: str, right: Column) -> Column:
    return left < right if op == "<" else left > right if op == ">" else left == right


def comparison(c: Comparison, resolve: Resolve, strict: bool = False) -> Column:
    left, right = bind_operand(c.left, resolve), bind_operand(c.right, resolve)
    comparable(left.kind, right.kind, strict)
    if left.is_time and c.right.kind == "string":
        by_day = _by_day(left, c.op, c.right.value)
    elif right.is_time and c.left.kind == "string":
        by_day = _by_day(right, {"<": ">", ">": "<", "=": "="}[c.op], c.left.value)
    else:
        by_day = None
    return _compare(left.value, c.op, right.value) if by_day is None else by_day


def any_of(group: list[Comparison], resolve: Resolve, strict: bool = False) -> Column:
    return reduce(or_, (comparison(c, resolve, strict) for c in group))


def predicate(cnf: Cnf, resolve: Resolve, strict: bool = False) -> Column:
    """All conjuncts as one column; true without any."""
    return reduce(and_, (any_of(g, resolve, strict) for g in cnf), F.lit(True)) if cnf else F.lit(True)


def arithmetic(e: Expression, resolve: Resolve) -> Bound:
    """Int with Int stays Int, and divides towards zero; with a Double both are Double."""
    if isinstance(e, Operand):
        out = bind_operand(e, resolve)
        if out.kind is Kind.STRING:
            raise TypeMismatch(f"{e} is a String; arithmetic takes numbers")
        return out
    if isinstance(e, Negative):
        out = arithmetic(e.of, resolve)
        return Bound(-out.value, out.kind)
    assert isinstance(e, Binary)
    left, right = arithmetic(e.left, resolve), arithmetic(e.right, resolve)
    kind = Kind.INT if left.kind is right.kind is Kind.INT else Kind.DOUBLE
    a, b = (x.value if kind is Kind.INT else x.value.cast("double") for x in (left, right))
    if e.op == "/" and kind is Kind.INT:
        return Bound(F.call_function("div", a, b), kind)
    return Bound({"+": a + b, "-": a - b, "*": a * b, "/": a / b}[e.op], kind)
