"""From a SELECT to a DataFrame: names, conjuncts and their places, the order of joins, and a plan to print."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousColumn, ColumnNotFound, EstimateError, InvalidQuery
from ..functions.columns import Bound, any_of, arithmetic, bind_column
from ..stats import Statistics
from .syntax import Binary, Comparison, Expression, Negative, Operand, Select, show_cnf


@dataclass
class Node:
    """An operator of the printed plan."""

    kind: str
    details: list[str]
    inputs: list[Node] = field(default_factory=list)

    def lines(self, depth: int = 0) -> list[str]:
        own = "  " * depth + self.kind + (": " + "; ".join(self.details) if self.details else "")
        return [own] + [x for n in self.inputs for x in n.lines(depth + 1)]

    def __str__(self) -> str:
        return "\n".join(self.lines())


class Scope:
    """The tables of a query by alias. Inside it a column has a name that holds its alias, so no two are alike."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.fields = {a: {f.name: f for f in df.schema} for a, df in tables.items()}

    def place(self, name: str) -> tuple[str, str]:
        """(alias, column) of a name with or without its alias."""
        alias, dot, column = name.rpartition(".")
        if dot:
            if alias not in self.fields or column not in self.fields[alias]:
                raise ColumnNotFound(name)
            return alias, column
        owners = [a for a, fields in self.fields.items() if name in fields]
        if not owners:
            raise ColumnNotFound(name)
        if len(owners) > 1:
            raise AmbiguousColumn(f"{name} may be of {', '.join(owners)}")
        return owners[0], name

    def inner(self, name: str) -> str:
        return ".".join(self.place(name))

    def resolve(self, name: str) -> Bound:
        alias, column = self.place(name)
        return bind_column(F.col(f"`{alias}.{column}`"), self.fields[alias][column].dataType)

    def frame(self, alias: str) -> DataFrame:
        return self.tables[alias].select(*(F.col(f"`{c}`").alias(f"{alias}.{c}") for c in self.fields[alias]))

    def aliases(self, group: list[Comparison]) -> set[str]:
        return {self.place(o.value)[0] for c in group for o in (c.left, c.right) if o.kind == "name"}


def _names(e: Expression) -> list[str]:
    if isinstance(e, Operand):
        return [e.value] if e.kind == "name" else []
    return _names(e.of) if isinstance(e, Negative) else _names(e.left) + _names(e.right) if isinstance(e, Binary) else []


def _check(q: Select, scope: Scope) -> None:
    aliases = [a for _, a in q.tables]
    if len(set(aliases)) < len(aliases):
        raise InvalidQuery("two tables have one alias")
    if q.group_by is not None and q.sum is None:
        raise InvalidQuery("GROUP BY without SUM")
    if q.sum is not None and q.attributes and q.group_by is None:
        raise InvalidQuery("SUM with columns needs GROUP BY")
    for name in [*q.attributes, *(q.group_by or []), *(_names(q.sum) if q.sum is not None else [])]:
        scope.place(name)
    if q.group_by is not None:
        keys = {scope.inner(k) for k in q.group_by}
        for name in q.attributes:
            if scope.inner(name) not in keys:
                raise InvalidQuery(f"{name} is not in GROUP BY")


def _order(aliases: list[str], groups: list[tuple[set[str], list[Comparison]]], statistics: Statistics | None, scope: Scope) -> list[str]:
    """Which table joins when: connected tables before others; with statistics the pair and then the table that leave fewest rows, else the smallest, else as written."""
    if len(aliases) < 3:
        return aliases

    def linked(done: list[str], a: str) -> bool:
        return any(a in used and used & set(done) and used <= {*done, a} for used, _ in groups)

    def size(done: list[str]) -> float:
        try:
            cnf = [[Comparison(*(Operand(o.kind, scope.inner(o.value) if o.kind == "name" else o.value) if isinstance(o, Operand) else o for o in (c.left, c.op, c.right))) for c in g] for used, g in groups if used and used <= set(done)]
            named = set().union(*(used for used, _ in groups if used and used <= set(done)))
            rows = statistics.estimate(cnf, done)
            for a in set(done) - named:
                rows *= statistics.relations[a].rows
            return rows
        except (EstimateError, KeyError):
            return 0.0

    if statistics is None:
        # without row counts, the sizes that Spark knows of the tables: small ones meet first
        weight = {a: int(str(scope.tables[a]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for a in aliases}

    def size(done: list[str], estimated=size) -> float:
        return estimated(done) if statistics is not None else float(sum(weight[a] for a in done))

    pairs = [[a, b] for i, a in enumerate(aliases) for b in aliases[i + 1 :]]
    done = min(pairs, key=lambda p: (not linked(p[:1], p[1]), size(p)))
    while len(done) < len(aliases):
        done = done + [min((a for a in aliases if a not in done), key=lambda a: (not linked(done, a), size([*done, a])))]
    return done


def _equals(groups: list[tuple[set[str], list[Comparison]]], scope: Scope) -> list[set[str]]:
    """Columns that conjuncts make equal, as sets of alias.column of one type."""
    out: list[set[str]] = []
    for _, g in groups:
        c = g[0]
        if len(g) == 1 and c.op == "=" and c.left.kind == c.right.kind == "name" and scope.resolve(c.left.value).kind is scope.resolve(c.right.value).kind:
            both = {scope.inner(c.left.value), scope.inner(c.right.value)}
            met = [s for s in out if s & both]
            out = [s for s in out if not s & both] + [both.union(*met)]
    return out


def _derived(group: list[Comparison], alias: str, equal: list[set[str]], scope: Scope) -> list[Comparison] | None:
    """The alternatives of a conjunct over several tables said of ``alias`` alone, by columns that equal its own; None if that cannot be."""

    def own(o: Operand) -> Operand | None:
        if o.kind != "name" or scope.place(o.value)[0] == alias:
            return o
        found = sorted(x for s in equal if scope.inner(o.value) in s for x in s if x.partition(".")[0] == alias)
        return Operand("name", found[0]) if found else None

    pairs = [(own(c.left), c.op, own(c.right)) for c in group]
    return None if any(a is None or b is None for a, _, b in pairs) else [Comparison(a, op, b) for a, op, b in pairs]


def prefix(q: Select, alias: str, keys: list[str], scope: Scope) -> dict[str, str | int | float]:
    """Values that conjuncts of one comparison give the leading sort keys of a table: each further key needs those before it."""
    kinds, given = {"string": str, "int": int, "float": float}, {}
    for group in q.where:
        c = group[0]
        if len(group) == 1 and c.op == "=" and (c.left.kind == "name") != (c.right.kind == "name"):
            name, value = (c.left, c.right) if c.left.kind == "name" else (c.right, c.left)
            at, column = scope.place(name.value)
            if at == alias and scope.resolve(name.value).kind.value.lower() in (value.kind, {"float": "double"}.get(value.kind)):
                given.setdefault(column, kinds[value.kind](value.value))
    out = {}
    for k in keys:
        if k not in given:
            break
        out[k] = given[k]
    return out


def plan(q: Select, tables: dict[str, DataFrame], statistics: Statistics | None = None, strict: bool = False, sort_keys: dict[str, list[str]] | None = None, lookup: Callable[..., DataFrame] | None = None) -> tuple[DataFrame, Node]:
    """The DataFrame of a SELECT over ``tables`` (by name) and its printable plan.

    Conjuncts of one table filter it; others join or filter as soon as their tables are
    there; all apply, whatever the number of tables. A conjunct over several tables also filters
    each one by itself for which columns made equal say as much. Of a table with ``sort_keys``
    whose leading keys are given, only what ``lookup`` finds is read. Spark prunes columns, pushes
    filters into scans and picks join strategies. ``statistics`` (by table name) order the joins.
    """
    scope = Scope({alias: tables[name] for name, alias in q.tables})
    _check(q, scope)
    found = {}
    for name, alias in q.tables:
        if sort_keys and (keys := prefix(q, alias, sort_keys.get(name, []), scope)):
            scope.tables[alias], found[alias] = lookup(name, **keys), keys
    if statistics is not None:
        known, statistics = statistics, Statistics()
        for name, alias in q.tables:
            if name in known.relations:
                statistics.relations[alias] = Statistics.copy(known).relations[name]
    groups = [(scope.aliases(g), g) for g in q.where]
    equal = _equals(groups, scope)
    frames, nodes = {}, {}
    for name, alias in q.tables:
        own = [g for used, g in groups if used == {alias}]
        own += [d for used, g in groups if len(g) > 1 and len(used) > 1 and (d := _derived(g, alias, equal, scope))]
        df = scope.frame(alias)
        for g in own:
            df = df.where(any_of(g, scope.resolve, strict))
        frames[alias] = df
        nodes[alias] = Node("SortedLookup" if alias in found else "SelectFile", [f"{name} AS {alias}", *(["by " + ", ".join(found[alias])] if alias in found else []), *([show_cnf(own)] if own else [])])
    order = _order([a for _, a in q.tables], groups, statistics, scope)
    left = [(used, g) for used, g in groups if len(used) != 1]
    df, node, done = frames[order[0]], nodes[order[0]], {order[0]}
    for alias in order[1:]:
        done.add(alias)
        now = [g for used, g in left if used and used <= done]
        left = [(used, g) for used, g in left if not (used and used <= done)]
        condition = None
        for g in now:
            c = any_of(g, scope.resolve, strict)
            condition = c if condition is None else condition & c
        df = df.crossJoin(frames[alias]) if condition is None else df.join(frames[alias], condition, "inner")
        node = Node("Join", [show_cnf(now) if now else "all pairs"], [node, nodes[alias]])
    for _, g in left:  # comparisons of literals
        df = df.where(any_of(g, scope.resolve, strict))
        node = Node("SelectPipe", [show_cnf([g])], [node])

    def shown(name: str) -> str:
        column = scope.place(name)[1]
        twice = sum(scope.place(n)[1] == column for n in dict.fromkeys(q.attributes)) > 1
        return scope.inner(name).replace(".", "_") if twice else column

    attributes = [scope.resolve(n).value.alias(shown(n)) for n in q.attributes]
    if q.sum is not None:
        value = arithmetic(q.sum, scope.resolve).value.cast("double")
        total = F.round(F.coalesce(F.sum_distinct(value) if q.sum_distinct else F.sum(value), F.lit(0.0)), 6).alias("sum")
        text = f"SUM {'DISTINCT ' if q.sum_distinct else ''}{q.sum}"
        if q.group_by is None:
            return df.agg(total), Node("Sum", [text], [node])
        keys = list(dict.fromkeys(scope.inner(k) for k in q.group_by))
        df = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(total)
        node = Node("GroupBy", [text, "by " + ", ".join(q.group_by)], [node])
        return df.select("sum", *attributes), Node("Project", [", ".join(["sum", *q.attributes])], [node])
    df, node = df.select(*attributes), Node("Project", [", ".join(q.attributes)], [node])
    return (df.distinct(), Node("Distinct", [], [node])) if q.distinct else (df, node)
