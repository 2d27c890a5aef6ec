"""Files as Tables: columns c0, c1, ... with their names and kinds, their layout, and each row's place.

A row's place orders rows as the file does. Parquet files give it by row index, which keeps filters
pushed down; for text it is numbered after the filters, as Spark keeps a file's splits in order.
"""

from __future__ import annotations

import csv
import io
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanFault
from ..functions.kinds import OTHER, STRING, kind_of
from .files import is_uri
from .schemas import FileSchema, Layout

DELIMITERS = ",|;\t"
#: Up to this many bytes, a local text file is read whole without a look for line breaks in its quoted fields.
MULTILINE_BYTES = 64 << 20
#: Quoting of text: none; quotes where a field begins with one; doubled quotes inside; all fields.
STANDARDS = ("NONE", "WEAK", "RFC4180", "ALL")


@dataclass
class Table:
    df: DataFrame
    names: list[str]
    kinds: list[str]
    layout: Layout
    path: str = ""
    place: Column | None = None  # a column over df for its rows' order; None: to be numbered
    raw: Callable[[], DataFrame] | None = None  # the same rows with the whole record as _rec

    def __post_init__(self) -> None:
        if len(self.names) != len(self.kinds):
            raise PlanFault("names and kinds differ in number")


@dataclass(frozen=True)
class Options:
    in_delim: str | None = None
    in_std: str = "RFC4180"
    strict: bool = False
    multiline: bool | None = None


def first_line(spark: SparkSession, path: str) -> str:
    if not is_uri(path) and os.path.isfile(path):
        with open(path, encoding="utf-8", errors="replace", newline="\n") as f:
            return f.readline().rstrip("\r\n")
    row = spark.read.text(path).first()
    return (row[0] if row else "").rstrip("\r")


def split_line(line: str, delimiter: str, standard: str) -> list[str]:
    if standard == "NONE" or len(delimiter) > 1:
        return line.split(delimiter)
    return next(csv.reader(io.StringIO(line), delimiter=delimiter), [""])


def guess_delimiter(line: str) -> str:
    best = max(DELIMITERS, key=lambda d: (len(split_line(line, d, "RFC4180")), -DELIMITERS.index(d)))
    return best if len(split_line(line, best, "RFC4180")) > 1 else ","


def _breaks_records(spark: SparkSession, path: str, delimiter: str, standard: str) -> bool:
    """Whether a record may span lines: a line has a quote outside of fields that are closed in it, or a carriage return before its end."""
    d, inner = re.escape(delimiter), '(?:""[^"]*+)*+' if standard != "WEAK" else ""
    closed = f'^(?:[^"]++|(?<=^|{d})"[^"]*+{inner}"(?={d}|\\z))*+\\z'
    line = F.regexp_replace("value", r"\r\z", "")
    return not spark.read.text(path, lineSep="\n").where(line.contains("\r") | line.contains('"') & ~line.rlike(closed)).isEmpty()


def _csv_options(spark: SparkSession, layout: Layout, options: Options, path: str) -> dict[str, str]:
    out = {"sep": layout.delimiter, "header": str(layout.header).lower(), "nullValue": "\u0001", "emptyValue": "", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "unescapedQuoteHandling": "STOP_AT_DELIMITER", "columnNameOfCorruptRecord": "_bad"}
    if options.in_std == "NONE":
        out |= {"quote": "\u0000", "escape": "\u0000"}
    elif options.in_std == "WEAK":
        out["escape"] = "\u0000"
    whole = options.multiline
    if whole is None:
        small = not is_uri(path) and os.path.isfile(path) and os.path.getsize(path) <= MULTILINE_BYTES
        whole = options.in_std != "NONE" and (small or _breaks_records(spark, path, layout.delimiter, options.in_std))
    return out | {"multiLine": str(whole).lower()}


def _strings(n: int) -> T.StructType:
    """Fields c0.., and _bad, which has the whole record if it has more or fewer fields."""
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)] + [T.StructField("_bad", T.StringType())])


def _cells(n: int, delimiter: str, at: str = "") -> list[Column]:
    """An empty field is an empty string; only one that a short record lacks is null. (Spark reads both as null.)"""
    bad = F.col(f"{at}_bad")
    there = F.size(F.split(bad, re.escape(delimiter)))
    return [F.when(F.col(f"{at}c{i}").isNotNull(), F.col(f"{at}c{i}")).when(bad.isNull() | (there > i), F.lit("")).alias(f"c{i}") for i in range(n)]


def read(spark: SparkSession, path: str, schema: FileSchema | None, options: Options) -> Table:
    """The table of a file; schema None: a header in the first line, the delimiter found there."""
    if path.lower().endswith(".parquet"):
        return read_parquet(spark, path)
    if schema and schema.layout.io == "fixed":
        return read_fixed(spark, path, schema)
    line = first_line(spark, path)
    delimiter = options.in_delim or guess_delimiter(line)
    cells = split_line(line, delimiter, options.in_std)
    layout = replace(schema.layout if schema else Layout(), delimiter=delimiter)
    if schema is None:
        names = cells
        if options.strict and len({n.lower() for n in names}) < len(names):
            raise PlanFault(f"{path} has columns of the same name")
    else:
        names = list(schema.names) if schema.names else [f"__{i + 1}" for i in range(len(cells))]
    parsing = _csv_options(spark, layout, options, path)
    reader = spark.read.schema(_strings(len(names))).options(**parsing)

    def raw() -> DataFrame:
        text = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
        text = text.where("_n > 0") if layout.header else text  # the first line is the first row of the first split
        parsed = F.from_csv("value", _strings(len(names)).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {k: v for k, v in parsing.items() if k not in ("header", "multiLine")})
        return text.select(parsed.alias("_p"), F.col("value").alias("_rec")).select(*_cells(len(names), delimiter, "_p."), "_rec")

    return Table(reader.csv(path).select(*_cells(len(names), delimiter)), names, [STRING] * len(names), layout, path, None, raw)


def read_fixed(spark: SparkSession, path: str, schema: FileSchema) -> Table:
    widths = schema.layout.widths
    total = sum(widths)
    names = list(schema.names or [f"__{i + 1}" for i in range(len(widths))])
    lines = _ends_lines(path, total, widths)
    if lines is None:  # no line breaks: records of so many bytes
        records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, total).map(lambda b: (bytes(b),)), "value binary")
        part = lambda at, w: F.decode(F.substring("value", at + 1, w), "UTF-8")
    else:
        records = spark.read.text(path, lineSep="\n")
        part = lambda at, w: F.substring("value", at + 1, w)
    columns, at = [], 0
    for i, w in enumerate(widths):
        last = lines and i == len(widths) - 1
        columns.append((F.lit("\n") if last else part(at, w)).alias(f"c{i}"))
        at += w
    df = records.select(*columns)
    rec = F.decode("value", "UTF-8") if lines is None else F.col("value")
    return Table(df, names, [STRING] * len(names), schema.layout, path, None, lambda: records.select(*columns, rec.alias("_rec")))


def _ends_lines(path: str, total: int, widths: tuple[int, ...]) -> bool | None:
    """True: the last field is the line break; False: a line break follows each record; None: neither."""
    if is_uri(path) or not os.path.isfile(path):
        return widths[-1] == 1
    with open(path, "rb") as f:
        start = f.read(total + 1)
    if widths[-1] == 1 and start[total - 1 : total] in (b"\n", b""):
        return True
    return False if start[total : total + 1] in (b"\n", b"\r", b"") else None


def _rank(files: list[str], name: Column) -> Column:
    """The file's rank by name, as one literal however many files there are; a row looks its name up among the few of the same checksum."""
    short = r"^([^/:]+):/+", r"$1:/"  # Spark lists file:///a and gives rows file:/a
    groups = ["\n"] * len(files)
    for rank, file in enumerate(sorted(re.sub(short[0], r"\1:/", f) for f in files)):
        groups[zlib.crc32(file.encode()) % len(files)] += f"{file}\t{rank}\n"
    name = F.regexp_replace(name, *short)
    group = F.get(F.split(F.lit("\1".join(groups)), "\1"), (F.crc32(name.cast("binary")) % F.lit(len(files))).cast("int"))
    after = F.call_function("substring_index", group, F.concat(F.lit("\n"), name, F.lit("\t")), F.lit(-1))
    return F.coalesce(F.substring_index(after, "\n", 1).try_cast("long"), F.raise_error(F.concat(F.lit("not a file of the table: "), name)).cast("long"))


def read_parquet(spark: SparkSession, path: str) -> Table:
    df = spark.read.parquet(path)
    names = df.columns
    kinds = [kind_of(f.dataType) for f in df.schema.fields]
    files = df.inputFiles()
    row = F.col("_metadata.row_index")
    if len(files) == 1:
        place = row
    else:
        place = _rank(files, F.col("_metadata.file_path")) * F.lit(1 << 40) + row
    return Table(df.toDF(*(f"c{i}" for i in range(len(names)))), names, kinds, Layout("parquet"), path, place)


def from_dataframe(df: DataFrame) -> Table:
    """Any DataFrame as a table."""
    return Table(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns, [kind_of(f.dataType) for f in df.schema.fields], Layout("parquet"))


def empty(spark: SparkSession, names: list[str], kinds: list[str], layout: Layout) -> Table:
    """A table that will be written before it is read."""
    types = {"int": "bigint", "float": "double"}
    return Table(spark.range(0).select(*(F.lit(None).cast(types.get(k, "string")).alias(f"c{i}") for i, k in enumerate(kinds))), names, kinds, layout)


__all__ = ["OTHER", "Options", "Table", "empty", "from_dataframe", "read", "read_parquet"]
