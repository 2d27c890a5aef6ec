"""Results as text: delimited or fixed-width lines, a header, quoting; and files that are replaced in one step."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import RunFault
from ..functions.kinds import FLOAT, Typed, to
from ..sources.files import is_uri
from ..sources.schemas import Layout


@dataclass(frozen=True)
class TextOptions:
    delimiter: str | None = None
    terminator: str = "\n"
    no_header: bool = False
    add_header: bool = False
    standard: str = "RFC4180"


def _cell(c: Column, kind: str) -> Column:
    text = to(Typed(c, kind), "string").col if kind != "other" else c.cast("string")
    return F.coalesce(text, F.lit(""))


def quoted(c: Column, delimiter: str, standard: str) -> Column:
    if standard == "NONE":
        return c
    doubled = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')) if standard != "WEAK" else c, F.lit('"'))
    if standard == "ALL":
        return doubled
    special = c.contains(delimiter) | c.contains('"') | c.contains("\n") | c.contains("\r")
    return F.when(special, doubled).otherwise(c)


def quote_value(s: str, delimiter: str, standard: str) -> str:
    if standard == "NONE" or standard != "ALL" and not any(x in s for x in (delimiter, '"', "\n", "\r")):
        return s
    return '"' + (s if standard == "WEAK" else s.replace('"', '""')) + '"'


def lines(df: DataFrame, kinds: list[str], layout: Layout, options: TextOptions) -> DataFrame:
    """One column, value: a line for each row, without its terminator."""
    cells = [_cell(F.col(f"`{c}`"), k) for c, k in zip(df.columns, kinds, strict=True)]
    if layout.io == "fixed":
        widths = [*layout.widths, *(0,) * len(cells)][: len(cells)]
        padded = []
        for c, k, w in zip(cells, kinds, widths, strict=True):
            fits = F.when(F.length(c) <= w, F.rpad(c, w, " ")).otherwise(F.raise_error(F.lit("Truncation error")).cast("string"))
            padded.append(fits if w else c)
        return df.select(F.concat(*padded).alias("value"))
    delimiter = options.delimiter or layout.delimiter
    return df.select(F.concat_ws(delimiter, *(quoted(c, delimiter, options.standard) if k not in ("int", FLOAT) or options.standard == "ALL" else c for c, k in zip(cells, kinds, strict=True))).alias("value"))


def header(names: list[str], layout: Layout, options: TextOptions) -> str | None:
    if layout.io == "fixed" or options.no_header or not layout.header and not options.add_header:
        return None
    delimiter = options.delimiter or layout.delimiter
    return delimiter.join(quote_value(n, delimiter, options.standard) for n in names)


def text_rows(df: DataFrame, names: list[str], kinds: list[str], layout: Layout, options: TextOptions) -> Iterator[str]:
    """The header and the lines, with terminators, a partition at a time."""
    end = "" if layout.io == "fixed" and layout.widths and layout.widths[-1] == 1 else options.terminator
    if (first := header(names, layout, options)) is not None:
        yield first + end
    for row in lines(df, kinds, layout, options).toLocalIterator():
        yield row[0] + end


def write(df: DataFrame, names: list[str], kinds: list[str], layout: Layout, path: str, options: TextOptions) -> int:
    """Write to a new place, then put it where path is; the rows written. On failure the old file stays."""
    if path.lower().endswith(".parquet"):
        return _write_parquet(df.toDF(*_distinct(names)), path)
    if is_uri(path):
        raise RunFault(f"text files are written to local or mounted folders, not to {path}; use a .parquet name")
    folder, name = os.path.split(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    temp = tempfile.mkdtemp(prefix=f".{name}-", dir=folder)
    try:
        seen = Observation()
        end = "" if layout.io == "fixed" and layout.widths and layout.widths[-1] == 1 else options.terminator
        parts = os.path.join(temp, "parts")
        rows = lines(df, kinds, layout, options).observe(seen, F.count(F.lit(1)).alias("n"))
        # all executors write their parts at once; the parts are joined in their order
        rows.write.option("lineSep", end or "\u0000").text(f"file://{parts}")
        whole = os.path.join(temp, "whole")
        with open(whole, "wb") as out:
            if (first := header(names, layout, options)) is not None:
                out.write((first + end).encode())
            for part in sorted(p for p in os.listdir(parts) if p.startswith("part-")):
                with open(os.path.join(parts, part), "rb") as f:
                    if end:
                        shutil.copyfileobj(f, out, 1 << 20)
                    else:
                        out.write(f.read().replace(b"\0", b""))
        os.replace(whole, os.path.join(folder, name))
        return int(seen.get["n"])
    finally:
        shutil.rmtree(temp, ignore_errors=True)


def _distinct(names: list[str]) -> list[str]:
    """Parquet needs names, all different."""
    out: list[str] = []
    for i, n in enumerate(names):
        own = n or f"_c{i + 1}"
        while own.lower() in {x.lower() for x in out}:
            own += "_"
        out.append(own)
    return out


def _write_parquet(df: DataFrame, path: str) -> int:
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if is_uri(path):
        rows.write.mode("overwrite").parquet(path)
        return int(seen.get["n"])
    path = os.path.abspath(path)
    folder, name = os.path.split(path)
    os.makedirs(folder, exist_ok=True)
    temp = tempfile.mkdtemp(prefix=f".{name}-", dir=folder)
    try:
        rows.write.parquet(f"file://{temp}/new")
        old = os.path.join(temp, "old")
        if os.path.exists(path):
            os.replace(path, old)
        os.replace(os.path.join(temp, "new"), path)
        return int(seen.get["n"])
    finally:
        shutil.rmtree(temp, ignore_errors=True)
