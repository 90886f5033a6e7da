"""Predicates built from (column, operator, value, connector) clauses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .names import col, require

OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "contains", "startswith", "in")


def _number(text: str) -> float | int | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return int(text) if text.lstrip("+-").isdigit() else value


def _clause(df: DataFrame, name: str, op: str, value) -> Column:
    if op not in OPERATORS:
        raise ValueError(f"unknown operator '{op}'; supported: {OPERATORS}")
    require(df, [name], "filter column")
    c = col(name)
    dtype = df.schema[name].dataType
    numeric = isinstance(dtype, T.NumericType)
    text = value.strip() if isinstance(value, str) else str(value)

    if op == "contains":
        return c.cast("string").rlike(text)
    if op == "startswith":
        return c.cast("string").startswith(text)
    if op == "in":
        items = [v.strip() if isinstance(v, str) else v
                 for v in (value.split(",") if isinstance(value, str) else value)]
        if numeric:
            numbers = [_number(str(v)) for v in items]
            items = [n for n in numbers if n is not None]
            return c.isin(items) if items else F.lit(False)
        return c.cast("string").isin([str(v) for v in items])

    number = _number(text)
    if numeric and number is not None:
        left, right = c, F.lit(number)
    elif numeric or isinstance(dtype, (T.StringType, T.BooleanType)):
        # A text column is compared as text, also with a value that looks like a number.
        left, right = c.cast("string"), F.lit(text)
    else:
        left, right = c, F.lit(text).cast(dtype)
    if op == "!=":
        return ~left.eqNullSafe(right)
    return {
        "==": left == right, ">": left > right, ">=": left >= right,
        "<": left < right, "<=": left <= right,
    }[op]


def where(df: DataFrame, clauses: Iterable[Sequence]) -> Column:
    """Combine clauses into one condition; ``and`` binds tighter than ``or``.

    Comparisons are left plain, so that Spark can push them into a scan: they are null
    for null cells, which a filter takes as false. A clause is ``(column, op, value)`` or ``(column, op, value, "and"|"or")``; the
    connector joins it to the clause before. Clauses with no column or a blank
    value are skipped.
    """
    groups: list[list[Column]] = []
    for clause in clauses:
        name, op, value, connector = (*clause, "and")[:4]
        if not name or (isinstance(value, str) and not value.strip()):
            continue
        if connector not in ("and", "or"):
            raise ValueError(f"connector must be 'and' or 'or', got '{connector}'")
        condition = _clause(df, name, op, value)
        if groups and connector == "and":
            groups[-1].append(condition)
        else:
            groups.append([condition])
    if not groups:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups))


def condition(df: DataFrame, spec) -> Column:
    """A Column, a Spark SQL string or a list of clauses, as one condition."""
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, str):
        return F.expr(spec)
    return where(df, spec)


def filter_rows(df: DataFrame, spec) -> DataFrame:
    """Keep rows meeting ``spec``; an empty spec keeps every row."""
    if spec is None or (isinstance(spec, (str, list, tuple)) and not spec):
        return df
    return df.filter(condition(df, spec))
