"""Grouped aggregation, as a summary table or attached to every row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import as_list, col, quoted, require, unused, with_keys
from ..plans.ordered import Sizes, in_chunks, order_key, ordering, quantile_middle, sizes
from ..session import materialize

SEPARATOR = "|"
FUNCTIONS = ("sum", "count", "size", "mean", "min", "max", "first", "last", "concat", "nunique",
             "std", "var", "sem", "prod", "median")


class Agg(NamedTuple):
    column: str
    function: str
    output: str


def parse_aggs(aggs: Iterable) -> list[Agg]:
    """Accept ``(column, function[, output])`` tuples or mappings with the keys
    ``column``, ``function`` and ``output_column``; the default name is column_function."""
    out = []
    for item in aggs:
        if isinstance(item, Mapping):
            item = (item.get("column") or "*", item.get("function") or "count",
                    item.get("output_column"))
        column, function, name = (*item, None)[:3]
        function = function.strip().lower()
        if function not in FUNCTIONS:
            raise ValueError(f"unknown aggregation '{function}'; supported: {FUNCTIONS}")
        if column in ("*", ""):
            column, function, name = "*", "size", name or "_row_count"
        out.append(Agg(column, function, name or f"{column}_{function}"))
    repeated = sorted({a.output for a in out if sum(b.output == a.output for b in out) > 1})
    if repeated:
        raise ValueError(f"several aggregations named {repeated}; set distinct output names")
    return out


def _plain(agg: Agg, order_by: Sequence[str]) -> Column:
    """Aggregates that Spark merges from partial results on its own."""
    if agg.function == "size":
        return F.count(F.lit(1))
    c = col(agg.column)
    if agg.function in ("first", "last"):
        if not order_by:
            raise ValueError(f"'{agg.function}' needs order_by")
        pick = F.min_by if agg.function == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), order_key(order_by)))
    return {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "count": lambda: F.count(c),
        "mean": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "nunique": lambda: F.count_distinct(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "sem": lambda: F.stddev_samp(c) / F.sqrt(F.count(c)),
        "prod": lambda: F.coalesce(F.product(c.cast("double")), F.lit(1.0)),
    }[agg.function]()


def _sorted_text(agg: Agg, order_by: Sequence[str]) -> Column:
    if not order_by:
        raise ValueError("'concat' needs order_by")
    by = ", ".join(quoted(o) for o in order_by)
    return F.expr(f"listagg(cast({quoted(agg.column)} as string), '{SEPARATOR}') "
                  f"within group (order by {by})")


def _long_text(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg],
               order_by: Sequence[str], size: Sizes) -> DataFrame:
    """Ordered concatenation in two steps: per range chunk, then the chunk texts per key."""
    chunk = unused(df, "chunk")
    rows = in_chunks(df, keys, [col(o).asc_nulls_first() for o in order_by], chunk, size,
                     "concat")
    by_keys = [col(k) for k in keys]
    parts = rows.groupBy(*by_keys, chunk).agg(
        *[_sorted_text(a, order_by).alias(a.output) for a in aggs])

    def glue(a: Agg) -> Column:
        pieces = F.collect_list(F.when(col(a.output).isNotNull(), F.struct(
            col(chunk).alias("at"), col(a.output).alias("text"))))
        return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), SEPARATOR)

    return parts.groupBy(*by_keys).agg(*[glue(a).alias(a.output) for a in aggs])


def _match(keys: Sequence[str], names: Sequence[str]) -> Column:
    return reduce(and_, [col(k).eqNullSafe(col(n)) for k, n in zip(keys, names)])


def _grouped(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], order_by: Sequence[str],
             max_group_rows: int | None) -> DataFrame:
    """All aggregates of ``df`` by ``keys`` in one pass, plus a pass for each kind of
    whole-group aggregate that turns out not to fit in one task."""
    whole = [a for a in aggs if a.function in ("median", "concat")]
    texts = [a for a in whole if a.function == "concat"]
    size = sizes(df, keys, [a.column for a in texts]) if whole else None
    small = whole and size.fit(max_group_rows)

    def value(a: Agg) -> Column:
        if a.function == "median":
            return F.median(col(a.column))
        if a.function == "concat":
            return F.coalesce(_sorted_text(a, order_by), F.lit(""))
        return _plain(a, order_by)

    direct = [a for a in aggs if small or a not in whole]
    by_keys = [col(k) for k in keys]
    outputs = [value(a).alias(a.output) for a in direct] or [F.count(F.lit(1)).alias("__rows")]
    result = df.groupBy(*by_keys).agg(*outputs)
    if whole and not small:
        extra = [quantile_middle(df, a.column, keys, a.output, max_group_rows=max_group_rows)
                 for a in whole if a.function == "median"]
        if texts:
            extra.append(_long_text(df, keys, texts, order_by, size))
        names = [f"__k{i}" for i in range(len(keys))]
        for table in extra:
            new = [c for c in table.columns if c not in keys]
            if keys:
                table = table.withColumnsRenamed(dict(zip(keys, names)))
                result = result.join(table, _match(keys, names), "left").drop(*names)
            else:
                result = result.withColumns({c: table.select(col(c)).scalar() for c in new})
        result = result.withColumns({a.output: F.coalesce(col(a.output), F.lit(""))
                                     for a in texts})
    return result.select(*by_keys, *[col(a.output) for a in aggs])


def aggregate(df: DataFrame, keys: Sequence[str], aggs: Iterable = (), *,
              order_by: Sequence[str] = (), max_group_rows: int | None = None) -> DataFrame:
    """One row per key. Rows with a null key are left out, as are unknown columns.

    Without aggregations the result is the distinct keys, the null ones included;
    the same keys are kept when every aggregation is a ``concat``.
    """
    keys, order_by = as_list(keys), as_list(order_by)
    require(df, keys, "group-by columns")
    specs = [a for a in parse_aggs(aggs) if a.column == "*" or a.column in df.columns]
    by_keys = [col(k) for k in keys]
    if not specs:
        return df.select(*by_keys).distinct()
    if all(a.function == "concat" for a in specs):
        known = reduce(and_, [k.isNotNull() for k in by_keys], F.lit(True))
        result = _grouped(df, keys, specs, order_by, max_group_rows)
        return result.withColumns({a.output: F.when(known, col(a.output)) for a in specs})
    return _grouped(with_keys(df, keys), keys, specs, order_by, max_group_rows)


def _attach_specs(df: DataFrame, keys: Sequence[str], aggs: Iterable) -> list[Agg]:
    require(df, keys, "group-by columns")
    specs = parse_aggs(aggs) or [Agg("*", "size", "_row_count")]
    require(df, [a.column for a in specs if a.column != "*"], "aggregated columns")
    clash = [a.output for a in specs if a.output in df.columns]
    if clash:
        raise ValueError(f"aggregation outputs {clash} already exist; choose other names")
    return specs


def _lookup(df: DataFrame, keys: Sequence[str], groups: DataFrame, how: str) -> DataFrame:
    """Join per-group values to rows; ``groups`` has no null keys, so those match nothing.

    The null-safe comparison keeps the join from reusing the aggregation's partitioning:
    only a join of two shuffles can have its hot keys split.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    groups = with_keys(groups, keys).withColumnsRenamed(dict(zip(keys, names)))
    return df.join(groups, _match(keys, names), how).drop(*names)


def attach_aggregates(df: DataFrame, keys: Sequence[str] = (), aggs: Iterable = (), *,
                      order_by: Sequence[str] = (), max_group_rows: int | None = None) -> DataFrame:
    """Keep every row and add its group's aggregates; null keys get null.

    The groups are reduced first and joined back, so a hot key is never gathered
    the way a window would. Without keys the aggregates of the whole table are
    added to each row; without aggregations the group size is added as ``_row_count``.
    """
    keys, order_by = as_list(keys), as_list(order_by)
    specs = _attach_specs(df, keys, aggs)
    outputs = [a.output for a in specs]
    if not keys:
        row = _grouped(df, [], specs, order_by, max_group_rows)
        one = unused(df, "stats")
        return (df.withColumn(one, row.select(F.struct(*[col(o) for o in outputs])).scalar())
                .withColumns({o: col(one).getField(o) for o in outputs}).drop(one))
    groups = _grouped(with_keys(df, keys), keys, specs, order_by, max_group_rows)
    return _lookup(df, keys, groups, "left")


def attach_top(df: DataFrame, keys: Sequence[str], aggs: Iterable, rank_by: str, top_n: int, *,
               ascending: bool = False, rank_column: str = "rank", order_by: Sequence[str] = (),
               max_group_rows: int | None = None) -> DataFrame:
    """``attach_aggregates`` followed by a top-N of rows ranked by one of the aggregates.

    All rows of a group share the aggregate, so ranks follow from the group sizes: the
    rows are read once to build the groups and once to fetch those of the few groups
    that make the top. Nulls, and rows with a null key, rank last.
    """
    keys, order_by = as_list(keys), as_list(order_by)
    specs = _attach_specs(df, keys, aggs)
    size = Agg("*", "size", unused(df, "size"))
    groups = materialize(_grouped(df, keys, [*specs, size], order_by, max_group_rows), "groups")
    keyless = reduce(or_, [col(k).isNull() for k in keys])
    value = F.when(~keyless, col(rank_by)).alias("__v")
    weights = groups.select(value, col(size.output).alias("__n"))
    # Every value stands for at least one row: at most N values can rank within N.
    order = ordering(F.col("__v"), ascending)
    top = (weights.filter("__v is not null").groupBy("__v").agg(F.sum("__n").alias("__n"))
           .orderBy(order).limit(top_n)
           .withColumn(rank_column, (F.lit(1) + F.coalesce(F.sum("__n").over(
               Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .cast("long"))
           .filter(col(rank_column) <= top_n).drop("__n"))
    best = groups.join(F.broadcast(top), col(rank_by) == F.col("__v")).drop("__v", size.output)
    result = _lookup(df, keys, best, "inner")
    last = weights.agg(F.count_if(F.col("__v").isNull()).alias("blank"),
                       F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))).alias("n")).first()
    if not last["blank"] or (last["n"] or 0) >= top_n:
        return result
    # Fewer than N rows have a value: the rows without one share the next rank.
    blank = groups.filter(col(rank_by).isNull()).drop(size.output)
    rest = _lookup(df, keys, blank.withColumn("__found", F.lit(True)), "left")
    rest = rest.filter(F.col("__found") | keyless).withColumn(
        rank_column, F.lit((last["n"] or 0) + 1).cast("long"))
    return result.unionByName(rest.drop("__found"))
