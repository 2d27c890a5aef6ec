"""Grouping and duplicates under the string comparison of the language.

Keys that differ in case or in blanks at the end are one group, shown as the row that came first
spelled them. Rows are grouped by exact spelling first: Spark then keeps fixed-size
aggregates in a hash table and combines on the map side; the groups, far fewer, are
grouped again by the compared keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Parts
from ..functions.kinds import STRING, Typed
from ..functions.text import ci


def grouped(df: DataFrame, keys: list[Typed], parts: list[Parts], row: Column | None) -> DataFrame:
    """Columns k0.. for keys, a0.. for aggregates, and _row, the first row's place, if row is given."""
    names = [[f"_p{i}_{j}" for j in range(len(p.partial))] for i, p in enumerate(parts)]
    partial = [c.alias(n) for p, own in zip(parts, names, strict=True) for c, n in zip(p.partial, own, strict=True)]
    final = [p.final([F.col(n) for n in own]).alias(f"a{i}") for i, (p, own) in enumerate(zip(parts, names, strict=True))]
    first = [F.min(row).alias("_row")] if row is not None else []
    shown = ["_row"] if row is not None else []
    if not keys:
        own = partial + first
        return df.agg(*own).select(*final, *shown) if own else df.limit(1).select(*final)
    exact = [k.col.alias(f"k{i}") for i, k in enumerate(keys)]
    texts = [i for i, k in enumerate(keys) if k.kind == STRING and not k.known]
    if not texts:
        return df.groupBy(*exact).agg(*partial, *first, *([] if partial or first else [F.count(F.lit(1)).alias("_n")])).select(*(f"k{i}" for i in range(len(keys))), *final, *shown)
    place = F.col("_row") if row is not None else F.lit(0)
    spelling = F.min(F.struct(place.alias("r"), *(F.col(f"k{i}") for i in texts))).alias("_s")
    by = [ci(F.col(f"k{i}")).alias(f"_c{i}") if i in texts else F.col(f"k{i}") for i in range(len(keys))]
    if all(p.splits for p in parts):
        inner = df.groupBy(*exact).agg(*partial, *first, *([] if partial or first else [F.count(F.lit(1)).alias("_n")]))
        merged = [m(F.col(n)).alias(n) for p, own in zip(parts, names, strict=True) for m, n in zip(p.merge, own, strict=True)]
        outer = inner.groupBy(*by).agg(spelling, *merged, *([F.min("_row").alias("_row")] if row is not None else []))
    else:
        rows = df.select("*", *exact, *([row.alias("_row")] if row is not None else []))
        outer = rows.groupBy(*by).agg(spelling, *partial, *([F.min("_row").alias("_row")] if row is not None else []))
    return outer.select(*((F.col(f"_s.k{i}") if i in texts else F.col(f"k{i}")).alias(f"k{i}") for i in range(len(keys))), *final, *shown)
