"""The public interface: an Engine runs scripts over the files of a folder."""

from __future__ import annotations

import copy
import os
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import PlanFault, RunFault, ScriptError
from .functions.kinds import OTHER, SPARK_TYPES, STRING, UNKNOWN, Typed, kind_of, literal
from .operators import sinks
from .plans import script as scripts
from .plans.planner import Env, Planned, Planner, Settings
from .plans.script import Event, Scope, Variable
from .sources import readers
from .sources.files import Finder, is_uri
from .sources.readers import Table
from .sources.schemas import Layout, named_schema
from .sql import nodes as N
from .sql.parser import parse
from .streaming.stdin import Spool


@dataclass
class Properties:
    """Options. threading, pipe_factor and stable are accepted for callers that set them; Spark needs none of them."""

    verbose: bool = False
    dry_run: bool = False
    overwrite: bool = False
    override_warnings: bool = False
    no_header: bool = False
    add_header: bool = False
    print_plan: bool = False
    in_delim: str | None = None
    out_delim: str | None = None
    record_terminator: str = "\n"
    crlf_output: bool = False
    char_as_byte: bool = False
    force_cartesian: bool = False
    schema_path: str | None = None
    schema: str | None = None
    strict: bool = False
    loose_groups: bool = False
    in_std: str = "RFC4180"
    out_std: str = "RFC4180"
    allow_stdin: bool = False
    parse_only: bool = False
    multiline: bool | None = None
    threading: bool = False
    pipe_factor: int = 4
    stable: bool = True


class Engine:
    """Runs scripts; tables are files under base (a folder or a URI that Spark reads)."""

    def __init__(self, spark: SparkSession, base: str = ".", stdin: BinaryIO | None = None, **properties: Any):
        self.spark, self.base = spark, base if is_uri(base) else os.path.abspath(base)
        self.properties = Properties()
        self.stdin = Spool(stdin, spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark)
        self.imported: dict[str, str] = {}
        self.registered: dict[str, Table] = {}
        self.written: dict[str, tuple[list[str], list[str], Layout]] = {}
        self.work = ""
        self.statements: tuple = ()
        self.scope = Scope()
        self.events: Iterator[Event] | None = None
        self.current: Event | None = None
        self.set(**properties)

    # Options

    def set(self, **properties: Any) -> Engine:
        for name, value in properties.items():
            if not hasattr(self.properties, name):
                raise ScriptError(f"there is no option {name}")
            if name in ("in_std", "out_std"):
                value = {"RFC-4180": "RFC4180"}.get(value.upper(), value.upper())
                if value not in readers.STANDARDS:
                    raise ScriptError(f"{name} is one of {', '.join(readers.STANDARDS)}")
            setattr(self.properties, name, value)
        return self

    def import_variable(self, declaration: str) -> Engine:
        """name=value; a string, until a DECLARE gives it another type."""
        name, equals, value = declaration.partition("=")
        if not equals or not name.strip():
            raise ScriptError("a variable is declared as name=value")
        self.imported["@" + name.strip().lstrip("@").upper()] = value
        return self

    def register(self, name: str, df: DataFrame) -> Engine:
        """Any DataFrame under a table's name."""
        self.registered[name.lower()] = readers.from_dataframe(df)
        return self

    def clone(self) -> Engine:
        """An engine with the same options and tables, and a state of its own."""
        own = Engine(self.spark, self.base)
        own.properties = copy.copy(self.properties)
        own.imported, own.registered = dict(self.imported), dict(self.registered)
        return own

    # Preparing and running

    def prepare(self, sql: str) -> int:
        """Parse, resolve and plan a whole script; the number of its statements. Nothing runs."""
        self.reset()
        self.statements = parse(sql, self.properties.override_warnings)
        self.scope = self._fresh_scope()
        if not self.properties.parse_only:
            written = dict(self.written)
            scripts.check(self, self.statements, self._fresh_scope())
            self.written = written
            self.stdin.reset()
        self.events = None
        return scripts.count(self.statements)

    def _fresh_scope(self) -> Scope:
        scope = Scope()
        for name, value in self.imported.items():
            scope.own[name] = Variable("VARCHAR", None, value, imported=True)
        return scope

    def run(self, n: int | None = None) -> list[Event]:
        """Run the next n statements of the prepared script, or all."""
        if self.properties.dry_run or self.properties.parse_only:
            return []
        if self.events is None:
            self.events = scripts.run(self, self.statements, self.scope)
        out: list[Event] = []
        while n is None or len(out) < n:
            event = next(self.events, None)
            if event is None:
                break
            self.current = event
            out.append(event)
        return out

    def until_select(self) -> Event | None:
        """Run up to the next SELECT that gives rows; None at the script's end."""
        while got := self.run(1):
            if got[0].kind == "select":
                return got[0]
        return None

    def execute(self, sql: str) -> list[Event]:
        """Prepare and run a script; the events of its SELECTs and writes."""
        self.prepare(sql)
        try:
            return [e for e in self.run() if e.kind != "flow"]
        finally:
            self.events = None

    def query(self, sql: str) -> DataFrame:
        """The result of a script's last SELECT as a DataFrame."""
        results = [e for e in self.execute(sql) if e.kind == "select"]
        if not results:
            raise RunFault("the script gives no rows")
        return results[-1].result.named()

    def rows(self) -> Iterator[tuple]:
        """The rows of the SELECT that ran last, a partition at a time."""
        if self.current is None or self.current.kind != "select":
            raise RunFault("no SELECT has run")
        return (tuple(r) for r in self.current.result.df.toLocalIterator())

    @property
    def field_count(self) -> int:
        return len(self.current.result.names) if self.current and self.current.result else 0

    @property
    def operation(self) -> str:
        """select, update, delete, into, or the kind of control flow that ran last."""
        return "" if self.current is None else describe(self.current.statement)[0]

    @property
    def operation_text(self) -> str:
        return "" if self.current is None else describe(self.current.statement)[1]

    def reset(self) -> None:
        """Forget the script, its variables and its temporary tables."""
        self.statements, self.scope, self.events, self.current = (), Scope(), None, None
        self.written = {}
        self.stdin.reset()
        self._drop_work()

    def close(self) -> None:
        self.reset()
        self.stdin.close()

    # For scripts

    def planner(self, scope: Scope, check: bool = False) -> Planner:
        p = self.properties
        settings = Settings(p.strict, p.loose_groups, p.char_as_byte, p.force_cartesian)
        return Planner(self.spark, lambda t: self.table(t, scope, check), lambda name: self.variable(name, scope, check), settings, check)

    def no_tables(self, scope: Scope) -> Env:
        return Env(self.planner(scope, True), [])

    def variable(self, name: str, scope: Scope, check: bool) -> Typed:
        variable = scope.find(name)
        if check:
            kind = variable.kind
            return Typed(F.lit(None).cast(SPARK_TYPES[kind]), kind) if not variable.imported else Typed(F.lit(variable.value), STRING)
        return literal(variable.value, variable.kind)

    def evaluate(self, node: N.Expr, scope: Scope) -> Typed:
        planner = self.planner(scope)
        typed = planner.expression(node, Env(planner, []))
        if typed.known:
            return typed
        value = self.spark.range(1).select(typed.col.alias("v")).first()[0]
        return Typed(F.lit(value), typed.kind, value)

    def holds(self, node: N.Expr, scope: Scope) -> bool:
        planner = self.planner(scope)
        env = Env(planner, [])
        condition = planner.condition(node, env)
        return bool(env.add(self.spark.range(1)).select(condition.alias("v")).first()[0])

    def table(self, name: N.TableName, scope: Scope, check: bool = False) -> Table:
        own = name.name
        if own.startswith("@"):
            variable = scope.find(own)
            if variable.value is None:
                if check:
                    raise _Later(own)
                raise PlanFault(f"{own} names no table")
            own = str(variable.value)
        if own.lower() == "__stdin":
            if not self.properties.allow_stdin:
                raise PlanFault("__STDIN is not allowed")
            path = self.stdin.take() if check else self.stdin.file()
            return readers.read(self.spark, path, self._schema(name.schema), self._read_options())
        if own.lower() in self.registered:
            return self.registered[own.lower()]
        path = self.place(own)
        key = self._key(path)
        if key in self.written:
            names, kinds, layout = self.written[key]
            if check:
                return readers.empty(self.spark, names, kinds, layout)
            return self._typed(readers.read(self.spark, path, None if layout.header else self._written_schema(names, layout), self._read_options(layout)), names, kinds)
        if own.startswith("#"):
            raise PlanFault(f"there is no table {own}")
        finder = Finder(self.spark, self.base, self.properties.strict)
        path = finder.find(own)
        key = self._key(path)
        if key in self.written:
            names, kinds, layout = self.written[key]
            if check:
                return readers.empty(self.spark, names, kinds, layout)
            return self._typed(readers.read(self.spark, path, None if layout.header else self._written_schema(names, layout), self._read_options(layout)), names, kinds)
        return readers.read(self.spark, path, self._schema(name.schema), self._read_options())

    def _written_schema(self, names: list[str], layout: Layout) -> Any:
        from .sources.schemas import FileSchema

        return FileSchema(tuple(n or f"__{i + 1}" for i, n in enumerate(names)), layout) if layout.io != "parquet" else None

    def _typed(self, table: Table, names: list[str], kinds: list[str]) -> Table:
        """A file that this script wrote keeps the kinds that it was written with."""
        if table.layout.io == "parquet" or len(table.names) != len(names):
            return table
        casts = [F.when(F.col(f"c{i}") != "", F.col(f"c{i}")).cast(SPARK_TYPES[k]).alias(f"c{i}") if k in ("int", "float") else F.col(f"c{i}") for i, k in enumerate(kinds)]
        return Table(table.df.select(*casts), names, [STRING if k == OTHER else k for k in kinds], table.layout, table.path)

    def _schema(self, name: str | None) -> Any:
        name = name or self.properties.schema
        return named_schema(name, self.properties.schema_path, [] if is_uri(self.base) else [self.base]) if name else None

    def _read_options(self, layout: Layout | None = None) -> readers.Options:
        p = self.properties
        delimiter = p.out_delim or layout.delimiter if layout else p.in_delim
        return readers.Options(delimiter, p.out_std if layout else p.in_std, p.strict, p.multiline)

    def place(self, name: str) -> str:
        """Where a file of this name is, or goes; temporary tables go to a folder that all executors share."""
        if not name.startswith("#"):
            return Finder(self.spark, self.base).place(name)
        if not self.work:
            context = self.spark.sparkContext
            shared = context.getConf().get("spark.checkpoint.dir")
            if shared:
                self.work = f"{shared.rstrip('/')}/marlstone-{uuid.uuid4().hex}"
            elif context.master.startswith("local"):
                self.work = tempfile.mkdtemp(prefix="marlstone-")
            else:
                raise RunFault("temporary tables need spark.checkpoint.dir, a folder that all executors share")
        return f"{self.work}/{name}.parquet"

    def _drop_work(self) -> None:
        if self.work and is_uri(self.work):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.work)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        elif self.work:
            shutil.rmtree(self.work, ignore_errors=True)
        self.work = ""

    def _key(self, path: str) -> str:
        return path if is_uri(path) else os.path.abspath(path)

    def _into(self, target: N.TableName, scope: Scope) -> str:
        name = target.name
        if name.startswith("@"):
            value = scope.find(name).value
            if value is None:
                raise PlanFault(f"{name} names no file")
            name = str(value)
        elif target.schema is not None:
            name = f"{target.schema}.{name}"
        return self.place(name)

    def _changed(self, target: N.TableName, scope: Scope) -> str:
        """The file that UPDATE or DELETE rewrites."""
        name = str(scope.find(target.name).value) if target.name.startswith("@") else target.name
        if name.startswith("#"):
            return self.place(name)
        path = self.place(name)
        return path if self._key(path) in self.written else Finder(self.spark, self.base, self.properties.strict).find(name)

    def foresee(self, statement: Any, scope: Scope) -> None:
        """Plan a statement without running it; note what it will write."""
        planner = self.planner(scope, True)
        try:
            if isinstance(statement, N.Select):
                planned = planner.select(statement)
                if statement.into is not None:
                    if statement.into.name.startswith("@") and scope.find(statement.into.name).value is None:
                        return
                    path = self._into(statement.into, scope)
                    if self._key(path) not in self.written:
                        self._may_write(path)
                    self.written[self._key(path)] = (planned.names, planned.kinds, planned.layout.text())
            else:
                planner.rewritten(statement)
        except _Later:
            return

    def _may_write(self, path: str) -> None:
        if not self.properties.overwrite and Finder(self.spark, self.base).exists(path) and not os.path.basename(path).startswith("#"):
            raise PlanFault(f"{path} exists; set overwrite to replace it")

    def perform(self, statement: Any, scope: Scope) -> Event:
        planner = self.planner(scope)
        if isinstance(statement, N.Select):
            planned = planner.select(statement)
            self._show(planned.df)
            if statement.into is None:
                return Event("select", statement, planned)
            path = self._into(statement.into, scope)
            if not self.properties.overwrite and self._key(path) not in self.written:
                self._may_write(path)
            return self._write(statement, planned, path)
        target, planned = planner.rewritten(statement)
        self._show(planned.df)
        return self._write(statement, planned, self._changed(target, scope))

    def _write(self, statement: Any, planned: Planned, path: str) -> Event:
        parquet = path.lower().endswith(".parquet")
        layout = planned.layout if planned.layout.io != "parquet" else Layout()
        if statement.__class__ is not N.Select and not parquet:
            options = self._text_options(plain=True)
        else:
            options = self._text_options()
        rows = sinks.write(planned.df, planned.names, planned.kinds, layout, path, options)
        self.spark.catalog.refreshByPath(path if is_uri(path) else f"file://{os.path.abspath(path)}")
        if isinstance(statement, N.Select) or self._key(path) in self.written:
            kinds = planned.kinds if not parquet else [kind_of(f.dataType) for f in planned.df.schema.fields]
            self.written[self._key(path)] = (planned.names, kinds, Layout("parquet") if parquet else layout)
        if self.properties.verbose:
            warnings.warn(f"{rows} rows affected", stacklevel=2)
        return Event("write", statement, planned, path, rows)

    def _text_options(self, plain: bool = False) -> sinks.TextOptions:
        p = self.properties
        end = "\r\n" if p.crlf_output else p.record_terminator
        return sinks.TextOptions(None if plain else p.out_delim, end, not plain and p.no_header, p.add_header, p.out_std)

    def _show(self, df: DataFrame) -> None:
        if self.properties.print_plan:
            df.explain("formatted")

    def text(self, event: Event) -> Iterator[str]:
        """A SELECT's rows as lines of text, as the command line prints them."""
        planned = event.result
        return sinks.text_rows(planned.df, planned.names, planned.kinds, planned.layout.text(), self._text_options())


class _Later(PlanFault):
    """A table whose name is only known when the script runs."""


def describe(statement: Any) -> tuple[str, str]:
    """The kind of a statement and its text, or a short form of it."""
    if isinstance(statement, N.Select):
        return ("into" if statement.into else "select"), statement.text
    if isinstance(statement, N.Update | N.Delete):
        return type(statement).__name__.lower(), statement.text
    name = type(statement).__name__.lower()
    return name, f"{name.upper()} {getattr(statement, 'name', '')}".strip()


__all__ = ["UNKNOWN", "Engine", "Event", "Properties"]
