"""UPDATE and DELETE as DataFrames: the rows that a file is to have afterwards.

With a join, each row is taken once; of several matches the first in file order of the joined
tables gives the new values. Rows are told apart by their place in the target's file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import not_


def deleted(target: DataFrame, condition: Column | None) -> DataFrame:
    return target.limit(0) if condition is None else target.where(not_(condition))


def deleted_by_join(target: DataFrame, matched: DataFrame, place: str) -> DataFrame:
    return target.join(matched.select(place).distinct(), place, "left_anti").orderBy(place)


def updated(target: DataFrame, condition: Column | None, values: dict[str, Column]) -> DataFrame:
    if condition is None:
        return target.withColumns(values)
    return target.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def updated_by_join(target: DataFrame, matched: DataFrame, place: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    new = F.struct(*(v.alias(c) for c, v in values.items()))
    first = matched.groupBy(place).agg(F.min_by(new, F.struct(*order) if order else F.lit(0)).alias("_new"), F.lit(True).alias("_met"))
    joined = target.join(first, place, "left").orderBy(place)
    return joined.withColumns({c: F.when(F.col("_met"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in values}).drop("_new", "_met")
