"""Routing one table to many outputs in a single pass.

Every function adds a ``_route`` column; ``write_routes`` writes all outputs at
once, ``route`` picks one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import col, require
from ..functions.predicates import condition
from ..functions.text import match_key, safe_label

ROUTE = "_route"
UNCHANGED = "unchanged"


def by_rules(df: DataFrame, rules: Mapping[str, object], unmatched: str | None = "unmatched",
             ) -> DataFrame:
    """Send a row to every rule it meets; rows meeting none go to ``unmatched``.

    A rule is a Column, a Spark SQL condition or a list of clauses. With
    ``unmatched=None`` rows meeting no rule are dropped.
    """
    if not rules:
        raise ValueError("no rules given")
    hits = F.array_compact(F.array(*[
        F.when(condition(df, rule), F.lit(label)) for label, rule in rules.items()]))
    none = F.array(F.lit(unmatched)) if unmatched else F.array().cast("array<string>")
    return df.withColumn(ROUTE, F.explode(F.when(F.size(hits) == 0, none).otherwise(hits)))


def _values(spec) -> list[str]:
    items = spec.split(",") if isinstance(spec, str) else spec
    return [v for v in (str(i).strip() if isinstance(spec, str) else str(i) for i in items) if v]


def _first_match(cell: Column, groups: Mapping[str, object], case_sensitive: bool,
                 trim: bool) -> Column:
    key = match_key(cell, case_sensitive, trim)
    route = None
    for label, spec in groups.items():
        values = _values(spec)
        if not values:
            raise ValueError(f"group '{label}' has no values")
        if not case_sensitive:
            values = [(v.strip() if trim else v).lower() for v in values]
        hit = key.isin(values)
        route = F.when(hit, label) if route is None else route.when(hit, label)
    return route


def by_values(df: DataFrame, column: str, groups: Mapping[str, object],
              others: str | None = "others", case_sensitive: bool = False) -> DataFrame:
    """Send each row to the first group listing its value; the rest and nulls to ``others``.

    Without case sensitivity cells and values are also trimmed. A table without the
    column passes through under the route ``unchanged``.
    """
    if not groups:
        raise ValueError("no value groups given")
    if column not in df.columns:
        return df.withColumn(ROUTE, F.lit(UNCHANGED))
    cell = col(column)
    routed = df.withColumn(ROUTE, F.coalesce(
        _first_match(cell, groups, case_sensitive, trim=not case_sensitive),
        F.lit(others)))
    return routed if others else routed.filter(F.col(ROUTE).isNotNull())


def by_groups(df: DataFrame, column: str, groups: Mapping[str, object], *,
              case_sensitive: bool = False, include_column: bool = True,
              nulls: str = "separate_file", null_label: str = "null",
              remaining: str = "separate_file", remaining_label: str = "remaining") -> DataFrame:
    """First matching group wins; nulls and the remaining rows follow their own policy.

    ``nulls``: separate_file, merge_into_remaining or discard; ``remaining``:
    separate_file or discard.
    """
    if nulls not in ("separate_file", "merge_into_remaining", "discard"):
        raise ValueError(f"unknown null policy '{nulls}'")
    if remaining not in ("separate_file", "discard"):
        raise ValueError(f"unknown remaining policy '{remaining}'")
    require(df, [column], "split column")
    cell = col(column)
    rest = F.lit(remaining_label if remaining == "separate_file" else None)
    blank = {"separate_file": F.lit(null_label), "merge_into_remaining": rest,
             "discard": F.lit(None)}[nulls]
    route = F.when(cell.isNull(), blank).otherwise(F.coalesce(
        _first_match(cell, groups, case_sensitive, trim=False), rest))
    routed = df.withColumn(ROUTE, route).filter(F.col(ROUTE).isNotNull())
    return routed if include_column else routed.drop(column)


def by_distinct(df: DataFrame, column: str, *, template: str = "{value}",
                include_column: bool = True) -> DataFrame:
    """One route per distinct value, named by ``template`` with ``{split_column}`` and
    ``{value}``; nulls go to ``<column>_NULL``."""
    if column not in df.columns:
        return df.withColumn(ROUTE, F.lit(UNCHANGED))
    pieces = template.replace("{split_column}", column).split("{value}")
    label = safe_label(col(column))
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [label, F.lit(piece)]
    routed = df.withColumn(ROUTE, F.coalesce(F.concat(*parts), F.lit(f"{column}_NULL")))
    return routed if include_column else routed.drop(column)


def route(routed: DataFrame, label: str) -> DataFrame:
    """The rows of one route."""
    return routed.filter(F.col(ROUTE) == label).drop(ROUTE)


def routes(routed: DataFrame, labels: Sequence[str]) -> dict[str, DataFrame]:
    return {label: route(routed, label) for label in labels}


def write_routes(routed: DataFrame, path: str, fmt: str = "parquet", *, original: DataFrame | None
                 = None, rebalance: bool = True, **options) -> list[str]:
    """Write every route below ``path`` in one job, one folder per route.

    Rebalancing gives few, even files: adaptive execution splits a large route over
    several tasks. ``original`` is also written, as the routing operators' inputs
    are. Returns the folders written to.
    """
    from ..sources.sinks import writer

    out = routed.hint("rebalance", F.col(ROUTE)) if rebalance else routed
    writer(out, fmt, **options).partitionBy(ROUTE).save(f"{path}/routes")
    folders = [f"{path}/routes"]
    if original is not None:
        writer(original, fmt, **options).save(f"{path}/original")
        folders.append(f"{path}/original")
    return folders
