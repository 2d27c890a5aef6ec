"""Aggregates. COUNT(x) is COUNT(*); AVG of whole numbers is whole; strings compare as they do elsewhere.

Each aggregate comes as parts for two steps, so that groups whose string keys differ in case or
blanks alone can be put together from the groups by exact spelling, which Spark keeps in a hash
table: partial columns, how partials merge, and the value from the merged ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanFault
from .kinds import FLOAT, INT, STRING, Typed, plain, to
from .text import ci


@dataclass
class Parts:
    kind: str
    partial: list[Column]
    merge: list[Callable[[Column], Column]]
    final: Callable[[list[Column]], Column]
    splits: bool = True  # whether it may be put together from partials


def aggregate(name: str, arg: Typed | None, distinct: bool, row: Column | None) -> Parts:
    """row: the place of a row in its file, for the first of equal strings."""
    only = lambda c: c[0]
    if name == "COUNT":
        if distinct and arg is not None:
            x = ci(arg.col) if plain(arg.kind) == STRING and arg.kind == STRING else arg.col
            return Parts(INT, [F.count_distinct(x)], [F.sum], only, False)
        return Parts(INT, [F.count(F.lit(1))], [F.sum], only)
    if arg is None:
        raise PlanFault(f"{name} needs an argument")
    if name in ("MIN", "MAX"):
        if arg.kind in (INT, FLOAT):
            f = F.min if name == "MIN" else F.max
            return Parts(arg.kind, [f(arg.col)], [f], only)
        x = to(arg, STRING).col
        place = row if row is not None else F.lit(0)
        place = place if name == "MIN" else -place
        key = F.when(x.isNotNull(), F.struct(ci(x).alias("k"), place.alias("r"), x.alias("x")))
        f = F.min if name == "MIN" else F.max
        return Parts(STRING, [f(key)], [f], lambda c: c[0]["x"])
    if arg.kind not in (INT, FLOAT):
        raise PlanFault(f"{name} does not take strings: cast the argument, or add 0")
    x = arg.col
    if distinct:
        own = F.sum_distinct(x) if name == "SUM" else F.call_function("div", F.sum_distinct(x), F.count_distinct(x)) if arg.kind == INT else F.sum_distinct(x) / F.count_distinct(x)
        return Parts(arg.kind, [own], [F.max], only, False)
    if name == "SUM":
        return Parts(arg.kind, [F.sum(x)], [F.sum], only)
    divide = (lambda c: F.when(c[1] > 0, F.call_function("div", c[0], c[1]))) if arg.kind == INT else (lambda c: F.when(c[1] > 0, c[0] / c[1]))
    return Parts(arg.kind, [F.sum(x), F.count(x)], [F.sum, F.sum], divide)
