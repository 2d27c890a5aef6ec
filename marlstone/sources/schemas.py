"""Schemas: what a file's fields are, and how its records are laid out."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from ..errors import PlanFault


@dataclass(frozen=True)
class Layout:
    """How records are laid out, which output takes over from the leftmost table."""

    io: str = "delimited"  # delimited, fixed, parquet
    delimiter: str = ","
    header: bool = True
    widths: tuple[int, ...] = ()
    terminator: str = "\n"

    def text(self) -> Layout:
        """As text output: Parquet becomes comma separated with a header."""
        return Layout() if self.io == "parquet" else self


@dataclass(frozen=True)
class FileSchema:
    """A named schema: field names, or None for numbered ones, and the layout."""

    names: tuple[str, ...] | None
    layout: Layout


NUMBERED = FileSchema(None, Layout(header=False))  # fields are __1, __2, ...


def search_path(schema_path: str | None) -> list[str]:
    home = os.path.join(os.path.expanduser("~"), ".config", "marlstone", "schema")
    return [p for p in (schema_path, os.environ.get("MARLSTONE_SCHEMA_PATH"), home) if p]


def named_schema(name: str, schema_path: str | None, find_in: list[str] = ()) -> FileSchema | None:
    """A schema by name; None for the default one."""
    if name.lower() == "default":
        return None
    for folder in [*search_path(schema_path), *find_in]:
        if not os.path.isdir(folder):
            continue
        files = sorted(os.listdir(folder))
        for same in (lambda f: f == name, lambda f: f.lower() == name.lower(), lambda f: f.rpartition(".")[0].lower() == name.lower() and f.lower().endswith(".schema")):
            found = [f for f in files if same(f) and os.path.isfile(os.path.join(folder, f))]
            if len(found) == 1:
                with open(os.path.join(folder, found[0]), encoding="utf-8") as f:
                    return parse_schema(f.read(), name)
    if name.lower() == "noheader":
        return NUMBERED
    raise PlanFault(f"no schema is named {name}")


def parse_schema(text: str, name: str = "") -> FileSchema:
    """Records name, or name,type: delimited without a header; name,width,type: fixed widths. a = b lines are skipped."""
    rows = [tuple(x.strip() for x in line.split(",")) for line in text.splitlines() if line.strip() and "=" not in line]
    if not rows:
        raise PlanFault(f"schema {name} is empty")
    if len({len(r) for r in rows}) > 1:
        raise PlanFault(f"records of schema {name} have different numbers of fields")
    if len(rows[0]) > 3:
        raise PlanFault(f"schema {name} has too many fields")
    names = tuple(r[0] for r in rows)
    if len(rows[0]) < 3:
        return FileSchema(names, Layout(header=False))
    try:
        widths = tuple(int(r[1]) for r in rows)
    except ValueError as e:
        raise PlanFault(f"schema {name} has a width that is no number") from e
    if min(widths) < 1:
        raise PlanFault(f"schema {name} has a width under 1")
    return FileSchema(names, Layout("fixed", header=False, widths=widths))


def with_delimiter(schema: FileSchema, delimiter: str) -> FileSchema:
    return replace(schema, layout=replace(schema.layout, delimiter=delimiter))
