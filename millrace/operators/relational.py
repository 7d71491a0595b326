"""The operators as functions from DataFrames to DataFrames, usable without the query language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ColumnNotFound
from ..functions.columns import Bound, Resolve, arithmetic, bind_column, predicate
from ..plans.syntax import Cnf, Expression, parse_cnf, parse_expression, parse_sort_keys
from ..types import Kind, kind_of


def resolver(df: DataFrame) -> Resolve:
    """Names of a DataFrame's columns; ``alias.name`` also finds a column called just that, or ``name``."""
    types = {f.name: f.dataType for f in df.schema}

    def resolve(name: str) -> Bound:
        for n in (name, name.rpartition(".")[2]):
            if n in types:
                return bind_column(F.col(f"`{n}`"), types[n])
        raise ColumnNotFound(name)

    return resolve


def _cnf(where: str | Cnf) -> Cnf:
    return parse_cnf(where) if isinstance(where, str) else where


def select_file(spark: SparkSession, path: str, where: str | Cnf = "", strict: bool = False) -> DataFrame:
    """The rows of a Parquet table that satisfy a predicate; the scan gets what of it Parquet can test."""
    return select_pipe(spark.read.parquet(path), where, strict)


def select_pipe(df: DataFrame, where: str | Cnf, strict: bool = False) -> DataFrame:
    """The rows that satisfy a predicate."""
    cnf = _cnf(where)
    return df.where(predicate(cnf, resolver(df), strict)) if cnf else df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Some columns in the given order; rows that become equal stay."""
    for c in columns:
        if c not in df.columns:
            raise ColumnNotFound(c)
    return df.select(*(F.col(f"`{c}`") for c in columns))


def join(left: DataFrame, right: DataFrame, where: str | Cnf = "", strict: bool = False, hint: str | None = None) -> DataFrame:
    """Pairs of rows that satisfy a predicate, with the columns of both; all pairs without one.

    Spark takes equalities between the sides as keys and the rest as a filter on pairs, and
    picks the strategy by sizes. ``hint`` asks for one. Both sides need names of their own.
    """
    if hint:
        right = right.hint(hint)
    cnf = _cnf(where)
    if not cnf:
        return left.crossJoin(right)
    both = {f.name: f.dataType for f in [*left.schema, *right.schema]}

    def resolve(name: str) -> Bound:
        for n in (name, name.rpartition(".")[2]):
            if n in both:
                side = left if n in left.columns else right
                return bind_column(side[f"`{n}`"], both[n])
        raise ColumnNotFound(name)

    return left.join(right, predicate(cnf, resolve, strict), "inner")


def distinct(df: DataFrame) -> DataFrame:
    """Rows once each."""
    return df.distinct()


def _summed(df: DataFrame, of: str | Expression, once: bool):
    bound = arithmetic(parse_expression(of) if isinstance(of, str) else of, resolver(df))
    value = bound.value.cast("double")
    return F.round(F.coalesce(F.sum_distinct(value) if once else F.sum(value), F.lit(0.0)), 6).alias("sum")


def sum_(df: DataFrame, of: str | Expression, once: bool = False) -> DataFrame:
    """One row: the sum of an expression as a Double with six decimals, 0.0 of no rows. ``once``: each value counts once."""
    return df.agg(_summed(df, of, once))


def group_by(df: DataFrame, keys: Sequence[str], of: str | Expression, once: bool = False) -> DataFrame:
    """A row for each group: its sum, then the keys. No rows give no groups."""
    for k in keys:
        if k not in df.columns:
            raise ColumnNotFound(k)
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(_summed(df, of, once)).select("sum", *(F.col(f"`{k}`") for k in keys))


def sort(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows in ascending order of columns, named in a list or as ``(a) AND (b)``."""
    keys = parse_sort_keys(keys) if isinstance(keys, str) else keys
    for k in keys:
        if k not in df.columns:
            raise ColumnNotFound(k)
    return df.sort(*(F.col(f"`{k}`").asc() for k in keys))


def default_order(df: DataFrame) -> list[str]:
    """All columns: Ints first, then Doubles, then Strings."""
    return [f.name for kind in (Kind.INT, Kind.DOUBLE, Kind.STRING) for f in df.schema if kind_of(f.dataType) is kind]
