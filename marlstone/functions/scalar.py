"""Operators and scalar functions over Typed values; known arguments are worked out while planning."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanFault
from .kinds import FLOAT, INT, SQL_TYPES, STRING, Typed, convert, literal, promote, to
from .text import ci, ci_value, like, like_column, like_regex

#: The longest text that SUBSTRING's guard for the start can mean.
FAR = 1 << 30


def _wrap(x: int) -> int:
    return x


def _div(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _known(op: str, kind: str, a: int | float | str, b: int | float | str) -> int | float | str:
    if op in "/%" and b == 0:
        raise PlanFault("division by zero")
    if kind == STRING:
        return a + b
    if op == "/":
        return _div(a, b) if kind == INT else a / b
    if op == "%":
        return a - _div(a, b) * b
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "&": lambda: a & b, "|": lambda: a | b, "^": lambda: a ^ b}[op]()


def binary(op: str, a: Typed, b: Typed) -> Typed:
    kind = promote(a.kind, b.kind)
    if kind == STRING and op != "+" or kind == FLOAT and op in "%&|^":
        raise PlanFault(f"{op} does not take {kind} values")
    a, b = to(a, kind), to(b, kind)
    if a.known and b.known:
        if a.value is None or b.value is None:
            return literal(None, kind)
        try:
            return literal(_known(op, kind, a.value, b.value), kind)
        except OverflowError as e:
            raise PlanFault(str(e)) from e
    x, y = a.col, b.col
    if kind == STRING:
        return Typed(F.concat(x, y), kind)
    if op == "/" and kind == INT:
        return Typed(F.call_function("div", x, y), kind)
    make: dict[str, Callable[[], Column]] = {
        "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y,
        "&": lambda: x.bitwiseAND(y), "|": lambda: x.bitwiseOR(y), "^": lambda: x.bitwiseXOR(y),
    }
    return Typed(make[op](), kind)


def unary(op: str, a: Typed) -> Typed:
    if a.kind == STRING and a.known and a.value is None:
        return literal(None, INT)
    if op == "~" and a.kind != INT or op == "-" and a.kind not in (INT, FLOAT):
        raise PlanFault(f"{op} does not take {a.kind} values")
    if a.known:
        return literal(None if a.value is None else -a.value if op == "-" else ~a.value, a.kind)
    return Typed(-a.col if op == "-" else F.bitwise_not(a.col), a.kind)


# Conditions: a Column that may be null, which counts as false


def compare(op: str, a: Typed, b: Typed) -> Column:
    kind = promote(a.kind, b.kind)
    a, b = to(a, kind), to(b, kind)
    x, y = (F.lit(ci_value(t.value)) if t.known and t.value is not None else ci(t.col) for t in (a, b)) if kind == STRING else (a.col, b.col)
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def in_list(a: Typed, items: list[Typed]) -> Column:
    """Null members say nothing."""
    kind = promote(a.kind, *(i.kind for i in items if not (i.known and i.value is None)))
    a, items = to(a, kind), [to(i, kind) for i in items if not (i.known and i.value is None)]
    x = ci(a.col) if kind == STRING else a.col
    known = [ci_value(i.value) if kind == STRING else i.value for i in items if i.known]
    out = x.isin(known) if known else F.lit(False)
    for i in items:
        if not i.known:
            out = out | F.coalesce(x == (ci(i.col) if kind == STRING else i.col), F.lit(False))
    return out


def like_condition(a: Typed, pattern: Typed) -> Column:
    a, pattern = to(a, STRING), to(pattern, STRING)
    if pattern.known and pattern.value is None:
        return F.lit(None).cast("boolean")
    if a.known and pattern.known and a.value is not None:
        return F.lit(re.fullmatch(like_regex(pattern.value)[5:-2], a.value, re.IGNORECASE) is not None)
    return like(a.col, pattern.value) if pattern.known else like_column(a.col, pattern.col)


def not_(c: Column) -> Column:
    """Two-valued: what is null counts as false, and its negation as true."""
    return ~F.coalesce(c, F.lit(False))


# Functions


def _guarded(ok: Column, out: Column, message: str) -> Column:
    return F.when(ok, out).otherwise(F.raise_error(F.lit(message)).cast("string"))


class Functions:
    """Scalar functions; with char_as_byte, LEN, LEFT, RIGHT and SUBSTRING count bytes."""

    def __init__(self, char_as_byte: bool = False):
        self.bytes = char_as_byte

    def call(self, name: str, args: list[Typed]) -> Typed:
        return getattr(self, f"_{name.lower()}")(*args)

    def _valid(self, s: Typed) -> Column:
        """Characters can't be counted in a text file's field that was no UTF-8; readers put U+FFFD where it was not."""
        if self.bytes or not s.raw:
            return s.col
        return F.when(s.col.contains("\ufffd"), F.raise_error(F.lit("invalid UTF-8")).cast("string")).otherwise(s.col)

    def _sliced(self, s: Typed, make: Callable[[Column], Column]) -> Column:
        return make(F.encode(s.col, "UTF-8")).cast("string") if self.bytes else make(self._valid(s))

    def _unit(self, s: str) -> str | bytes:
        return s.encode() if self.bytes else s

    def _text(self, s: str | bytes) -> str:
        return s.decode("utf-8", "replace") if isinstance(s, bytes) else s

    def _len(self, a: Typed) -> Typed:
        s = to(a, STRING)
        if s.known:
            return literal(None if s.value is None else len(self._unit(s.value.rstrip())), INT)
        trimmed = F.regexp_replace(self._valid(s), r"\s+$", "")
        return Typed((F.octet_length(trimmed) if self.bytes else F.length(trimmed)).cast("bigint"), INT)

    def _datalength(self, a: Typed) -> Typed:
        if a.known:
            return literal(None if a.value is None else 8 if a.kind in (INT, FLOAT) else len(a.value.encode()), INT)
        if a.kind in (INT, FLOAT):
            return Typed(F.when(a.col.isNotNull(), F.lit(8)).cast("bigint"), INT)
        return Typed(F.octet_length(to(a, STRING).col).cast("bigint"), INT)

    def _left(self, a: Typed, n: Typed) -> Typed:
        s, n = to(a, STRING), to(n, INT)
        if n.known and n.value is not None and n.value < 0:
            raise PlanFault("LEFT of a negative number of characters")
        if s.known and n.known:
            return literal(None if None in (s.value, n.value) else self._text(self._unit(s.value)[: n.value]), STRING)
        size = F.least(n.col, F.lit(FAR)).cast("int")
        out = self._sliced(s, lambda c: F.substring(c, F.lit(1), size))
        return Typed(out if n.known else _guarded((n.col >= 0) | n.col.isNull() | s.col.isNull(), out, "LEFT of a negative number of characters"), STRING)

    def _right(self, a: Typed, n: Typed) -> Typed:
        s, n = to(a, STRING), to(n, INT)
        if n.known and n.value is not None and n.value < 0:
            raise PlanFault("RIGHT of a negative number of characters")
        if s.known and n.known:
            return literal(None if None in (s.value, n.value) else self._text(self._unit(s.value)[max(0, len(self._unit(s.value)) - n.value) :]), STRING)
        size = F.least(n.col, F.lit(FAR)).cast("int")
        length = F.octet_length(s.col) if self.bytes else F.length(s.col)
        out = self._sliced(s, lambda c: F.substring(c, F.greatest(length - size, F.lit(0)) + F.lit(1), size))
        return Typed(out if n.known else _guarded((n.col >= 0) | n.col.isNull() | s.col.isNull(), out, "RIGHT of a negative number of characters"), STRING)

    def _substring(self, a: Typed, start: Typed, n: Typed) -> Typed:
        s, start, n = to(a, STRING), to(start, INT), to(n, INT)
        if n.known and n.value is not None and n.value < 0:
            raise PlanFault("SUBSTRING of a negative number of characters")
        if s.known and start.known and n.known:
            if None in (s.value, start.value, n.value):
                return literal(None, STRING)
            first = max(start.value, 1)
            size = max(n.value + min(start.value - 1, 0), 0)
            return literal(self._text(self._unit(s.value)[first - 1 : first - 1 + size]), STRING)
        # a start before the text shortens the piece
        first = F.least(F.greatest(start.col, F.lit(1)), F.lit(FAR)).cast("int")
        size = F.least(F.greatest(n.col + F.least(start.col - F.lit(1), F.lit(0)), F.lit(0)), F.lit(FAR)).cast("int")
        out = self._sliced(s, lambda c: F.substring(c, first, size))
        return Typed(out if n.known else _guarded((n.col >= 0) | n.col.isNull() | s.col.isNull(), out, "SUBSTRING of a negative number of characters"), STRING)

    def _replace(self, a: Typed, find: Typed, new: Typed) -> Typed:
        s, find, new = to(a, STRING), to(find, STRING), to(new, STRING)
        if s.known and find.known and new.known:
            if None in (s.value, find.value, new.value):
                return literal(None, STRING)
            return literal(re.sub(re.escape(find.value), lambda _: new.value, s.value, flags=re.IGNORECASE) if find.value else s.value, STRING)
        quoted = F.regexp_replace(find.col, r"\\E", r"\\E\\\\E\\Q")
        swap = F.regexp_replace(new.col, r"([\\$])", r"\\$1")
        out = F.regexp_replace(s.col, F.concat(F.lit(r"(?iu)\Q"), quoted, F.lit(r"\E")), swap)
        return Typed(F.when(find.col == "", F.when(new.col.isNotNull(), s.col)).otherwise(out), STRING)

    def _isnull(self, a: Typed, b: Typed) -> Typed:
        if a.known and a.value is None and a.kind == STRING:
            return b
        b = to(b, a.kind if a.kind in (INT, FLOAT) else STRING)
        a = a if a.kind in (INT, FLOAT) else to(a, STRING)
        if a.known and (b.known or a.value is not None):
            return a if a.value is not None else b
        return Typed(F.coalesce(a.col, b.col), a.kind)

    def cast(self, a: Typed, name: str, size: int | None) -> Typed:
        kind = SQL_TYPES.get(name)
        if kind is None:
            raise PlanFault(f"type {name} is not implemented")
        if kind == "bit":
            a = to(a, INT)
            if a.known:
                return literal(None if a.value is None else int(a.value != 0), INT)
            return Typed(F.when(a.col != 0, F.lit(1)).when(a.col.isNotNull(), F.lit(0)).cast("bigint"), INT)
        if kind in (INT, FLOAT):
            if kind == INT and a.known and isinstance(a.value, float) and not math.isfinite(a.value):
                raise PlanFault("not a whole number")
            return to(a, kind)
        a = to(a, STRING)
        if size is None or kind == STRING:
            return a
        if kind == "varchar":
            return self._left(a, literal(size))
        if a.known:
            return literal(None if a.value is None else self._text(self._unit(a.value)[:size].ljust(size)), STRING)
        return Typed(F.rpad(a.col, size, " "), STRING)

    def case(self, branches: list[tuple[Column, Typed]], default: Typed | None) -> Typed:
        values = [v for _, v in branches] + ([default] if default else [])
        kind = promote(*(v.kind for v in values if not (v.known and v.value is None)))
        out = F
        for when, value in branches:
            out = out.when(when, to(value, kind).col)
        return Typed(out.otherwise(to(default, kind).col) if default else out, kind)


__all__ = ["Functions", "binary", "compare", "convert", "in_list", "like_condition", "not_", "unary"]
