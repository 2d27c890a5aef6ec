"""The three kinds of values, their promotion and conversion.

Whole numbers are bigint, floats double, all else string; columns of other Spark types
pass through as they are and become strings inside expressions. A Typed holds a Column and,
where it is known while planning, the value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanFault

INT, FLOAT, STRING, OTHER = "int", "float", "string", "other"
UNKNOWN = object()
SPARK_TYPES = {INT: "bigint", FLOAT: "double", STRING: "string"}
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1

#: Declared types and the kinds they stand for.
SQL_TYPES = {
    "INT": INT, "BIGINT": INT, "TINYINT": INT, "SMALLINT": INT, "BIT": "bit", "FLOAT": FLOAT, "REAL": FLOAT,
    "VARCHAR": "varchar", "NVARCHAR": "varchar", "TEXT": STRING, "NTEXT": STRING, "CHAR": "char", "NCHAR": "char",
}

_HEX, _DECIMAL = re.compile(r"0x[0-9A-Fa-f]+"), re.compile(r"\s*[-+]?\d+")
_FLOAT = re.compile(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?")


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: str
    value: Any = UNKNOWN
    raw: bool = False  # a text file's field as it was read

    @property
    def known(self) -> bool:
        return self.value is not UNKNOWN


def literal(value: float | str | None, kind: str | None = None) -> Typed:
    kind = kind or (INT if isinstance(value, int) else FLOAT if isinstance(value, float) else STRING)
    if kind == INT and value is not None and not LONG_MIN <= value <= LONG_MAX:
        raise PlanFault(f"{value} is out of range")
    return Typed(F.lit(value).cast(SPARK_TYPES[kind]), kind, value)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return INT
    if isinstance(data_type, T.FractionalType):
        return FLOAT
    return STRING if isinstance(data_type, T.StringType) else OTHER


def column(col: Column, kind: str, raw: bool = False) -> Typed:
    """A source's column, numbers widened."""
    return Typed(col.cast(SPARK_TYPES[kind]) if kind in (INT, FLOAT) else col, kind, raw=raw)


def plain(kind: str) -> str:
    return STRING if kind == OTHER else kind


def promote(*kinds: str) -> str:
    """The same kind stays; a number wins over a string, a float over a whole number."""
    kinds = tuple(plain(k) for k in kinds)
    return FLOAT if FLOAT in kinds else INT if INT in kinds else STRING


# Conversion of values while planning


def convert(value: Any, kind: str) -> Any:
    if value is None:
        return None
    if kind == INT:
        if isinstance(value, str):
            if value == "":
                return 0
            if not _HEX.fullmatch(value) and not _DECIMAL.fullmatch(value):
                raise PlanFault(f"{value!r} is not a whole number")
            value = int(value, 16) if _HEX.fullmatch(value) else int(value)
        value = int(value)
        if not LONG_MIN <= value <= LONG_MAX:
            raise PlanFault(f"{value} is out of range")
        return value
    if kind == FLOAT:
        if isinstance(value, str) and not _FLOAT.fullmatch(value):
            if value == "":
                return 0.0
            if _HEX.fullmatch(value):
                return float(int(value, 16))
            raise PlanFault(f"{value!r} is not a number")
        return float(value)
    return value if isinstance(value, str) else f"{value:.6f}" if isinstance(value, float) else str(value)


def to(x: Typed, kind: str) -> Typed:
    """x as another kind; a string that is no number fails when it is met, or now if it is known."""
    if x.known:
        return literal(convert(x.value, kind), kind)
    if x.kind == kind:
        return x
    c = x.col
    if x.kind == OTHER:
        c = c.cast("string")
    if kind == STRING:
        return Typed(F.format_string("%.6f", c) if x.kind == FLOAT else c.cast("string"), STRING)
    if x.kind in (INT, FLOAT):
        return Typed(c.cast(SPARK_TYPES[kind]), kind)
    hexed = F.conv(F.substring(c, 3, 1 << 20), 16, 10).cast("bigint")
    # the guards stand inside one expression, so that the cast is only met where it applies
    out = F.when(c.rlike("^0x[0-9A-Fa-f]+$"), hexed.cast(SPARK_TYPES[kind])).when(c == "", F.lit(0).cast(SPARK_TYPES[kind])).otherwise(c.cast(SPARK_TYPES[kind]))
    return Typed(out, kind)
