"""Statements to DataFrames.

Names are resolved against the tables in scope; expressions become Typed columns; Catalyst does the
rest. A statement may be planned before it runs (check), with tables that earlier statements will
write as empty stand-ins and variables as nulls of their kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanFault, SyntaxFault
from ..functions import scalar as S
from ..functions.aggregates import aggregate
from ..functions.kinds import FLOAT, INT, OTHER, SPARK_TYPES, STRING, UNKNOWN, Typed, column, literal, plain, promote, to
from ..functions.text import ci
from ..operators import rewriting
from ..operators.grouping import grouped
from ..operators.numbering import numbered, settled
from ..sources.readers import Table
from ..sources.schemas import Layout
from ..sql import nodes as N

CONSTANTS = {"__lf": "\n", "__cr": "\r", "__crlf": "\r\n"}


@dataclass
class Settings:
    strict: bool = False
    loose_groups: bool = False
    char_as_byte: bool = False
    force_cartesian: bool = False


@dataclass
class InScope:
    """A table of a FROM clause: its columns are named s<i>_<j> in the joined DataFrame."""

    alias: str
    names: list[str]
    columns: list[str]
    kinds: list[str]
    layout: Layout
    place: str | None = None
    rec: str | None = None

    def typed(self, j: int) -> Typed:
        return column(F.col(self.columns[j]), self.kinds[j], self.layout.io != "parquet")


@dataclass
class Planned:
    """A result: columns o0.. with names (empty for unnamed ones) and kinds."""

    df: DataFrame
    names: list[str]
    kinds: list[str]
    layout: Layout

    def named(self) -> DataFrame:
        """With the names as column names; _c1.. for unnamed ones."""
        return self.df.toDF(*(n or f"_c{i + 1}" for i, n in enumerate(self.names)))


@dataclass
class Env:
    """What expressions of one clause may refer to."""

    planner: Planner
    scope: list[InScope]
    cells: dict[Any, Typed] | None = None  # grouped: canonical expression to column
    extra: dict[str, Column] = field(default_factory=dict)  # columns that conditions need added first
    rownum: str | None = None
    in_join: bool = False

    def add(self, df: DataFrame) -> DataFrame:
        if self.extra:
            df = df.withColumns(self.extra)
            self.extra = {}
        return df


def walk(node: Any) -> Iterator[Any]:
    """All nodes of an expression, without those of subqueries."""
    yield node
    if isinstance(node, N.Subquery):
        return
    for value in vars(node).values() if isinstance(node, N.Expr) else ():
        for x in value if isinstance(value, tuple) else (value,):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, N.Expr):
                    yield from walk(y)


class Planner:
    def __init__(self, spark: SparkSession, table: Callable[[N.TableName], Table], variable: Callable[[str], Typed], settings: Settings, check: bool = False):
        self.spark, self.variable, self.settings, self.check = spark, variable, settings, check
        self._find, self._tables = table, {}
        self.functions = S.Functions(settings.char_as_byte)
        self.serial = 0

    # Tables

    def table(self, name: N.TableName) -> Table:
        """A table, looked up once in a statement; standard input each time, as it may be used once."""
        if name.name.lower() == "__stdin":
            return self._find(name)
        if name not in self._tables:
            self._tables[name] = self._find(name)
        return self._tables[name]

    def fresh(self, prefix: str) -> str:
        self.serial += 1
        return f"{prefix}{self.serial}"

    def source(self, source: N.Source, want_place: bool, want_rec: bool) -> tuple[DataFrame, InScope]:
        own = self.fresh("s")
        if isinstance(source.table, N.Select):
            planned = self.select(source.table)
            names, kinds = planned.names, planned.kinds
            columns = [f"{own}_{j}" for j in range(len(names))]
            df, place, rec = planned.df.toDF(*columns), None, None
            if want_place:
                df, place = df.withColumn(f"{own}_row", F.monotonically_increasing_id()), f"{own}_row"
            return df, InScope((source.alias or "").lower(), names, columns, kinds, planned.layout, place, rec)
        table = self.table(source.table)
        columns = [f"{own}_{j}" for j in range(len(table.names))]
        alias = source.alias or source.table.name.rpartition("/")[2]
        df, rec, place = table.df, None, None
        picks = [F.col(f"c{j}").alias(c) for j, c in enumerate(columns)]
        if want_rec:
            rec = f"{own}_rec"
            if table.raw:
                df = table.raw()
                picks.append(F.col("_rec").alias(rec))
            else:
                picks.append(F.concat_ws(table.layout.text().delimiter, *(F.coalesce(F.col(f"c{j}").cast("string"), F.lit("")) for j in range(len(columns)))).alias(rec))
        if want_place:
            place = f"{own}_row"
            picks.append((table.place if table.place is not None and not (want_rec and table.raw) else F.monotonically_increasing_id()).alias(place))
        return df.select(*picks), InScope(alias.lower(), table.names, columns, table.kinds, table.layout, place, rec)

    def sources(self, source: N.Source, joins: tuple[N.Join, ...], want_place: bool, want_rec: bool) -> tuple[DataFrame, list[InScope]]:
        df, first = self.source(source, want_place, want_rec)
        scope = [first]
        for join in joins:
            right, own = self.source(join.source, want_place, want_rec)
            scope.append(own)
            env = Env(self, scope, in_join=True)
            if any(isinstance(x, N.Aggregate) for x in walk(join.on)):
                raise PlanFault("aggregates can't stand in ON")
            on = self.condition(join.on, env)
            if self.settings.force_cartesian and join.kind == "inner":
                df = df.hint("shuffle_replicate_nl").join(right.hint("shuffle_replicate_nl"), on, "inner")
            else:
                df = df.join(right, on, join.kind)
        return df, scope

    # Names

    def resolve(self, name: N.Name, scope: list[InScope]) -> Typed:
        found = []
        for s in scope:
            if name.table is not None and s.alias != name.table and s.alias.rpartition(".")[0] != name.table:
                continue
            own = [j for j, n in enumerate(s.names) if n.lower() == name.column]
            if self.settings.strict and len(own) > 1:
                raise PlanFault(f"column {name.column} is there more than once")
            if own:
                found.append(s.typed(own[0]))
        shown = f"{name.table}.{name.column}" if name.table else name.column
        if len(found) > 1:
            raise PlanFault(f"column {shown} is ambiguous")
        if not found:
            if name.column in CONSTANTS and name.table is None:
                return literal(CONSTANTS[name.column])
            raise PlanFault(f"there is no column {shown}")
        return found[0]

    def canonical(self, node: Any, env: Env) -> Any:
        """A key that expressions of the same meaning share: names resolved, known parts worked out."""
        if isinstance(node, N.Name) and not node.column.startswith("__row"):
            if node.column == "__rec":
                return ("rec", node.table)
            typed = self.resolve(node, env.scope)
            return ("value", typed.kind, typed.value) if typed.known else ("column", str(typed.col))
        if isinstance(node, N.Expr) and not isinstance(node, N.Aggregate | N.Subquery) and not any(isinstance(x, N.Name | N.Aggregate | N.Subquery | N.Star | N.InQuery) for x in walk(node)):
            if not isinstance(node, N.Compare | N.Logic | N.Not | N.InList | N.Like | N.IsNull | N.Between):
                typed = self.expression(node, Env(self, []))
                if typed.known:
                    return ("value", typed.kind, typed.value)
        if isinstance(node, N.Expr):
            return (type(node).__name__, *(self.canonical(v, env) for v in vars(node).values()))
        if isinstance(node, tuple):
            return tuple(self.canonical(x, env) for x in node)
        return node

    # Expressions

    def expression(self, node: N.Expr, env: Env) -> Typed:
        if env.cells is not None and not isinstance(node, N.Literal | N.Variable):
            key = self.canonical(node, env)
            if key in env.cells:
                return env.cells[key]
        if isinstance(node, N.Literal):
            return literal(node.value)
        if isinstance(node, N.Variable):
            return self.variable(node.name)
        if isinstance(node, N.Name):
            return self.name(node, env)
        if isinstance(node, N.Aggregate):
            raise PlanFault(f"aggregate {node.name} can't stand here")
        if isinstance(node, N.Unary):
            return S.unary(node.op, self.expression(node.arg, env))
        if isinstance(node, N.Binary):
            return S.binary(node.op, self.expression(node.left, env), self.expression(node.right, env))
        if isinstance(node, N.Call):
            return self.functions.call(node.name, [self.expression(a, env) for a in node.args])
        if isinstance(node, N.Cast):
            return self.functions.cast(self.expression(node.arg, env), node.kind, node.size)
        if isinstance(node, N.Case):
            return self.case(node, env)
        if isinstance(node, N.Subquery):
            return self.scalar(node.query)
        raise PlanFault(f"{type(node).__name__} can't stand here")

    def name(self, node: N.Name, env: Env) -> Typed:
        if node.column == "__rec":
            own = [s for s in env.scope if s.rec and (node.table is None or s.alias == node.table)]
            if env.cells is not None or len(own) != 1:
                raise PlanFault("__REC needs one table")
            return Typed(F.col(own[0].rec), STRING)
        if node.column == "__rownum":
            if not env.rownum:
                raise PlanFault("__ROWNUM can stand in the select list of an ungrouped query")
            return Typed(F.col(env.rownum), INT)
        typed = self.resolve(node, env.scope)
        if env.cells is not None and not typed.known:
            raise PlanFault(f"column {node.column} is neither grouped nor aggregated")
        return typed

    def case(self, node: N.Case, env: Env) -> Typed:
        branches = []
        subject = self.expression(node.subject, env) if node.subject else None
        for when, then in node.branches:
            test = self.condition(when, env) if subject is None else S.compare("=", subject, self.expression(when, env))
            branches.append((test, self.expression(then, env)))
        return self.functions.case(branches, self.expression(node.default, env) if node.default else None)

    def scalar(self, query: N.Select) -> Typed:
        """A scalar subquery: null for no row, a failure for several."""
        planned = self.select(query)
        if len(planned.names) != 1:
            raise PlanFault("a subquery in an expression has one column")
        if self.check:
            return Typed(F.lit(None).cast(SPARK_TYPES.get(planned.kinds[0], "string")), plain(planned.kinds[0]))
        if query.source is None and not query.unions and query.where is None and query.top is None and not query.group:
            known = self.expression(query.items[0].expr, Env(self, []))
            if known.known:
                return known
        out = planned.df if planned.kinds[0] != OTHER else planned.df.select(F.col("o0").cast("string"))
        return Typed(out.scalar(), plain(planned.kinds[0]))

    # Conditions

    def condition(self, node: N.Expr, env: Env) -> Column:
        if isinstance(node, N.Logic):
            left, right = self.condition(node.left, env), self.condition(node.right, env)
            return left & right if node.op == "AND" else left | right
        if isinstance(node, N.Not):
            return S.not_(self.condition(node.arg, env))
        if isinstance(node, N.Compare):
            return S.compare(node.op, self.expression(node.left, env), self.expression(node.right, env))
        if isinstance(node, N.IsNull):
            c = self.expression(node.arg, env)
            return c.col.isNotNull() if node.negated else c.col.isNull()
        if isinstance(node, N.InList):
            out = S.in_list(self.expression(node.arg, env), [self.expression(i, env) for i in node.items])
        elif isinstance(node, N.Like):
            out = S.like_condition(self.expression(node.arg, env), self.expression(node.pattern, env))
        elif isinstance(node, N.Between):
            arg = self.expression(node.arg, env)
            out = S.compare(">=", arg, self.expression(node.low, env)) & S.compare("<=", arg, self.expression(node.high, env))
        elif isinstance(node, N.InQuery):
            out = self.in_query(node, env)
            return ~out if node.negated else out
        else:
            raise PlanFault(f"{type(node).__name__} is no condition")
        return S.not_(out) if node.negated else out

    def in_query(self, node: N.InQuery, env: Env) -> Column:
        """Whether the subquery has the value: a semi or anti join on the compared keys; nulls never match."""
        if env.in_join:
            raise PlanFault("IN with a subquery can't stand in ON")
        planned = self.select(node.query)
        if len(planned.names) != 1:
            raise PlanFault("a subquery of IN has one column")
        arg = self.expression(node.arg, env)
        kind = promote(arg.kind, planned.kinds[0])
        member = to(column(F.col("o0"), planned.kinds[0]), kind).col
        key = to(arg, kind).col
        if kind == STRING:
            member, key = ci(member), ci(key)
        name = self.fresh("_in")
        env.extra[name] = key
        members = planned.df.select(member.alias(f"{name}_m")).where(F.col(f"{name}_m").isNotNull())
        return members.where(F.col(f"{name}_m") == F.col(name).outer()).exists()

    # SELECT

    def select(self, query: N.Select) -> Planned:
        if not query.unions:
            return self.branch(query, query.order)
        branches = [self.branch(q, (), "_row" if i == 0 else None) for i, q in enumerate((query, *query.unions))]
        widths = {len(b.names) for b in branches}
        if len(widths) > 1:
            raise PlanFault("branches of UNION ALL have different numbers of columns")
        kinds = [promote(*(b.kinds[j] for b in branches)) if len({b.kinds[j] for b in branches}) > 1 else branches[0].kinds[j] for j in range(len(branches[0].names))]
        out = None
        for b in branches:
            own = b.df.select(*((F.col(f"o{j}") if b.kinds[j] == k else to(column(F.col(f"o{j}"), b.kinds[j]), k).col).alias(f"o{j}") for j, k in enumerate(kinds)))
            out = own if out is None else out.unionAll(own)
        names = branches[0].names
        planned = Planned(out, names, kinds, branches[0].layout)
        if query.order:
            scope = [InScope("", names, [f"o{j}" for j in range(len(names))], kinds, planned.layout)]
            env = Env(self, scope)
            keys = [self._order_key(self._ordinal(o, planned) or self.expression(o.expr, env), o) for o in query.order]
            planned.df = out.orderBy(*keys)
        return planned

    def top(self, query: N.Select) -> int | None:
        if query.top is None:
            return None
        n = self.expression(query.top, Env(self, []))
        if not n.known:
            if self.check:
                return 0
            raise PlanFault("TOP takes a constant")
        if n.kind != INT or n.value is None or n.value < 0:
            raise PlanFault("TOP takes a whole number from 0")
        return n.value

    def _order_key(self, typed: Typed, order: N.Order) -> Column:
        key = ci(typed.col) if typed.kind == STRING else typed.col
        return key.desc() if order.descending else key.asc()

    def _ordinal(self, order: N.Order, planned: Planned) -> Typed | None:
        if isinstance(order.expr, N.Literal) and isinstance(order.expr.value, int):
            n = order.expr.value
            if not 1 <= n <= len(planned.names):
                raise PlanFault(f"ORDER BY {n} is out of range")
            return Typed(F.col(f"o{n - 1}"), planned.kinds[n - 1])
        return None

    def expand(self, items: tuple[N.Item, ...], scope: list[InScope]) -> list[tuple[str, N.Expr | Typed]]:
        """The select list with stars written out: (name, expression or column)."""
        out: list[tuple[str, N.Expr | Typed]] = []
        for item in items:
            if isinstance(item.expr, N.Star):
                own = [s for s in scope if item.expr.table in (None, s.alias)]
                if not own:
                    raise PlanFault(f"no table {item.expr.table or ''} for *")
                out += [(n, s.typed(j)) for s in own for j, n in enumerate(s.names)]
            else:
                name = item.alias if item.alias is not None else item.expr.column if isinstance(item.expr, N.Name) else ""
                if item.alias is None and isinstance(item.expr, N.Name):
                    name = next((n for s in scope for n in s.names if n.lower() == item.expr.column), item.expr.column)
                out.append((name, item.expr))
        return out

    def branch(self, query: N.Select, order: tuple[N.Order, ...], row: str | None = None) -> Planned:
        exprs = [i.expr for i in query.items]
        nodes = [x for e in [*exprs, *(o.expr for o in order), *query.group, *([query.where] if query.where else []), *([query.having] if query.having else [])] for x in walk(e)]
        names_used = {x.column for x in nodes if isinstance(x, N.Name)}
        has_aggregates = any(isinstance(x, N.Aggregate) for e in [*exprs, *(o.expr for o in order), *([query.having] if query.having else [])] for x in walk(e))
        is_grouped = bool(query.group) or has_aggregates
        if query.having is not None and not is_grouped:
            raise PlanFault("HAVING needs GROUP BY or an aggregate")
        for clause, node in (("WHERE", query.where), *(("GROUP BY", g) for g in query.group)):
            if node is not None and any(isinstance(x, N.Aggregate) for x in walk(node)):
                raise PlanFault(f"aggregates can't stand in {clause}")
        top = self.top(query)
        wants_rows = is_grouped or query.distinct or top is not None
        if query.source is None:
            df, scope, layout = self.spark.range(1).select(F.lit(0).alias("_none")), [], Layout()
            if any(isinstance(e, N.Star) for e in exprs):
                raise PlanFault("* needs a table")
            order = tuple(o for o in order if isinstance(o.expr, N.Literal))
        else:
            df, scope = self.sources(query.source, query.joins, wants_rows and bool(query.joins) or wants_rows and self._keeps_place(query.source), "__rec" in names_used)
            layout = scope[0].layout
        if "__rec" in names_used and len(scope) != 1:
            raise PlanFault("__REC needs one table")
        env = Env(self, scope)
        if query.where is not None:
            condition = self.condition(query.where, env)
            df = env.add(df).where(condition)
        row_col: Column | None = None
        if wants_rows and scope:
            if scope[0].place:
                row_col = F.col(scope[0].place)
            else:
                df = df.withColumn("_place", F.monotonically_increasing_id())
                row_col = F.col("_place")
        if "__rownum" in names_used and not is_grouped:
            env.rownum = "_rownum"
            if not scope:
                df = df.withColumn("_rownum", F.lit(1).cast("bigint"))
            elif self.check:
                df = df.withColumn("_rownum", F.lit(0).cast("bigint"))
            else:
                df = numbered(settled(df) if query.joins else df, "_rownum")
        items = self.expand(query.items, scope)
        if is_grouped:
            df, env, row_col = self.group(query, order, df, env, row_col, items)
        out = [e if isinstance(e, Typed) else self._output(e, env) for _, e in items]
        if is_grouped and any(isinstance(e, Typed) for _, e in items):
            out = [self._starred(e, env) if isinstance(e, Typed) else o for (_, e), o in zip(items, out, strict=True)]
        planned = Planned(df, [n for n, _ in items], [t.kind for t in out], layout)
        if query.having is not None:
            condition = self.condition(query.having, env)
            df = env.add(df).where(condition)
        # order keys that are no output columns ride along
        keys: list[Typed] = []
        for o in order:
            keys.append(self._ordinal(o, planned) or self._order_expression(o, query, items, env, out))
        df = env.add(df)
        columns = [t.col.alias(f"o{j}") for j, t in enumerate(out)]
        ride = [k.col.alias(f"_k{j}") for j, k in enumerate(keys)]
        places = [row_col.alias("_row")] if row_col is not None else []
        if query.distinct:
            if order and any(not str(k.col).startswith("Column<'o") for k in keys):
                raise PlanFault("with DISTINCT, ORDER BY takes what is selected")
            df = grouped(df.select(*columns, *places), [Typed(F.col(f"o{j}"), t.kind, t.value if t.known else UNKNOWN) for j, t in enumerate(out)], [], F.col("_row") if places else None)
            df = df.select(*(F.col(f"k{j}").alias(f"o{j}") for j in range(len(out))), *(["_row"] if places else []))
            by = [self._order_key(k, o) for k, o in zip(keys, order, strict=True)]
        else:
            ordinals = [str(k.col).startswith("Column<'o") for k in keys]
            df = df.select(*columns, *(r for r, is_out in zip(ride, ordinals, strict=True) if not is_out), *places)
            by = [self._order_key(k if is_out else Typed(F.col(f"_k{j}"), k.kind), o) for j, (k, o, is_out) in enumerate(zip(keys, order, ordinals, strict=True))]
        if top is not None:
            by = by + ([F.col("_row").asc()] if places else [])
        if by:
            df = df.orderBy(*by)
        if top is not None:
            df = df.limit(top)
        planned.df = df.select(*(f"o{j}" for j in range(len(out))))
        return planned

    def _keeps_place(self, source: N.Source) -> bool:
        """Parquet tables know their rows' places; other rows are numbered after the filter."""
        return isinstance(source.table, N.TableName) and source.table.name.lower() != "__stdin" and self.table(source.table).place is not None

    def _output(self, node: N.Expr, env: Env) -> Typed:
        return self.expression(node, env)

    def _starred(self, typed: Typed, env: Env) -> Typed:
        key = ("column", str(typed.col))
        if env.cells is None or key not in env.cells:
            raise PlanFault("* has columns that are neither grouped nor aggregated")
        return env.cells[key]

    def _order_expression(self, order: N.Order, query: N.Select, items: list, env: Env, out: list[Typed]) -> Typed:
        """A select alias, else what is selected in the same words, else any expression."""
        if isinstance(order.expr, N.Name) and order.expr.table is None:
            named = [j for j, item in enumerate(query.items) if item.alias is not None and item.alias.lower() == order.expr.column]
            if len(named) > 1:
                raise PlanFault(f"{order.expr.column} in ORDER BY is ambiguous")
            if named:
                at = [j for j, (n, e) in enumerate(items) if n.lower() == order.expr.column and not isinstance(e, Typed)]
                return Typed(F.col(f"o{at[0]}"), out[at[0]].kind)
        if query.distinct:
            own = self.canonical(order.expr, env)
            for j, (_, e) in enumerate(items):
                same = ("column", str(e.col)) if isinstance(e, Typed) else self.canonical(e, env)
                if same == own:
                    return Typed(F.col(f"o{j}"), out[j].kind)
        return self.expression(order.expr, env)

    def group(self, query: N.Select, order: tuple[N.Order, ...], df: DataFrame, env: Env, row: Column | None, items: list) -> tuple[DataFrame, Env, Column | None]:
        """The grouped rows, and an Env in which expressions mean their columns."""
        if self.settings.loose_groups and query.group:
            return self.loose(query, df, env, row)
        keys = [self.expression(g, env) for g in query.group]
        cells: dict[Any, Typed] = {}
        for i, (g, k) in enumerate(zip(query.group, keys, strict=True)):
            cells[self.canonical(g, env)] = Typed(F.col(f"k{i}"), k.kind)
        parts, seen = [], {}
        for e in [*(i.expr for i in query.items), *(o.expr for o in order), *([query.having] if query.having else [])]:
            for x in walk(e):
                if isinstance(x, N.Aggregate):
                    key = self.canonical(x, env)
                    if key not in seen:
                        seen[key] = len(parts)
                        inner = any(isinstance(y, N.Aggregate) for y in walk(x.arg)) if x.arg else False
                        if inner:
                            raise PlanFault("aggregates can't be nested")
                        parts.append(aggregate(x.name, self.expression(x.arg, env) if x.arg else None, x.distinct, row))
        for key, i in seen.items():
            cells[key] = Typed(F.col(f"a{i}"), parts[i].kind)
        df = env.add(df)
        needs_row = row is not None and (any(k.kind == STRING and not k.known for k in keys) or query.top is not None)
        out = grouped(df, keys, parts, row if needs_row else None)
        if not keys and not parts:
            raise PlanFault("nothing to group")
        return out, Env(self, env.scope, cells), F.col("_row") if needs_row else None

    def loose(self, query: N.Select, df: DataFrame, env: Env, row: Column | None) -> tuple[DataFrame, Env, Column | None]:
        """Groups that show their first row; aggregates are off."""
        if any(isinstance(x, N.Aggregate) for i in query.items for x in walk(i.expr)):
            raise PlanFault("loose groups have no aggregates")
        keys = [self.expression(g, env) for g in query.group]
        by = [ci(k.col) if k.kind == STRING else k.col for k in keys]
        columns = [c for s in env.scope for c in s.columns]
        place = row if row is not None else F.lit(0)
        first = env.add(df).groupBy(*(b.alias(f"_g{i}") for i, b in enumerate(by))).agg(F.min_by(F.struct(*columns), place).alias("_f"), F.min(place).alias("_row"))
        return first.select("_f.*", "_row"), Env(self, env.scope), F.col("_row")

    # UPDATE and DELETE

    def target(self, statement: N.Update | N.Delete) -> tuple[N.TableName, N.Source]:
        """The file that changes, and the source that stands for it: the leftmost one."""
        source = statement.source or N.Source(statement.target, None)
        if isinstance(source.table, N.Select):
            raise PlanFault("a subquery can't be changed")
        named = statement.target.name.lower()
        if named not in ((source.alias or "").lower(), source.table.name.lower(), source.table.name.rpartition(".")[0].lower()) and statement.source is not None:
            if statement.target.name.rpartition(".")[0].lower() != source.table.name.lower():
                raise PlanFault(f"{statement.target.name} is not the first table of FROM")
        return source.table, source

    def rewritten(self, statement: N.Update | N.Delete) -> tuple[N.TableName, Planned]:
        """The rows that the target is to have."""
        table_name, source = self.target(statement)
        joined = bool(statement.joins)
        df, scope = self.sources(source, statement.joins, joined, False)
        own = scope[0]
        env = Env(self, scope)
        if statement.where is not None and any(isinstance(x, N.Aggregate) for x in walk(statement.where)):
            raise PlanFault("aggregates can't stand in WHERE")
        condition = self.condition(statement.where, env) if statement.where is not None else None
        values: dict[str, Column] = {}
        if isinstance(statement, N.Update):
            for name, node in statement.sets:
                at = [j for j, n in enumerate(own.names) if n.lower() == name.lower()]
                if not at:
                    raise PlanFault(f"there is no column {name}")
                kind = plain(own.kinds[at[0]])
                values[own.columns[at[0]]] = to(self.expression(node, env), kind).col
        df = env.add(df)
        if joined:
            target_table = self.table(table_name)
            place = own.place
            target = target_table.df.select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(own.columns)), (target_table.place if target_table.place is not None else F.monotonically_increasing_id()).alias(place))
            matched = df if condition is None else df.where(condition)
            if isinstance(statement, N.Update):
                out = rewriting.updated_by_join(target, matched, place, [F.col(s.place) for s in scope[1:]], values)
            else:
                out = rewriting.deleted_by_join(target, matched, place)
        elif isinstance(statement, N.Update):
            out = rewriting.updated(df, condition, values)
        else:
            out = rewriting.deleted(df, condition)
        return table_name, Planned(out.select(*(F.col(c).alias(f"o{j}") for j, c in enumerate(own.columns))), own.names, own.kinds, own.layout)


__all__ = ["FLOAT", "Planned", "Planner", "Settings", "SyntaxFault"]
