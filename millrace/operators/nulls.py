"""Null detection, audit and filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.casts import to_float
from ..functions.names import as_list, col, existing, with_keys
from ..functions.text import strip
from ..plans.ordered import carry_values, quantile_middle, sizes

STRATEGIES = ("fill", "mean", "median", "mode", "forward_fill", "backward_fill", "drop_row")


class Cleaned(NamedTuple):
    result: DataFrame
    audit: DataFrame


def replace_tokens(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Turn the given texts into nulls in every text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not tokens or not texts:
        return df
    return df.withColumns({c: F.when(~F.coalesce(col(c).isin(*tokens), F.lit(False)), col(c))
                           for c in texts})


def null_audit(df: DataFrame) -> DataFrame:
    """Column, Null_Count, Total_Rows and Null_Pct of the columns that hold nulls."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__total"),
                    *[F.count_if(col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(names)])
    rows = counts.select("__total", F.inline(F.array(*[
        F.struct(F.lit(c).alias("Column"), F.col(f"__n{i}").alias("Null_Count"))
        for i, c in enumerate(names)])))
    return rows.filter("Null_Count > 0").select(
        "Column", "Null_Count", F.col("__total").alias("Total_Rows"),
        F.round(F.col("Null_Count") / F.col("__total") * 100, 2).alias("Null_Pct"))


def _fill_constant(df: DataFrame, name: str, value) -> DataFrame:
    dtype = df.schema[name].dataType
    if not isinstance(dtype, T.StringType):
        checked = df.sparkSession.range(1).select(
            F.lit(str(value)).try_cast(dtype.simpleString()).alias("v")).first()
        if checked["v"] is None:
            raise ValueError(f"fill value {value!r} is not a {dtype.simpleString()} "
                             f"as column '{name}' needs")
    return df.withColumn(name, F.coalesce(col(name), F.lit(str(value)).cast(dtype)))


def _fill_numbers(df: DataFrame, names: Sequence[str], strategy: str,
                  max_group_rows: int | None) -> DataFrame:
    """Mean or median of the cells that read as numbers, for all columns in one pass.

    Text columns receive the number as text, whole-number columns become double.
    """
    texts = {n for n in names if isinstance(df.schema[n].dataType, T.StringType)}
    names = [n for n in names if n in texts or isinstance(df.schema[n].dataType, T.NumericType)]
    if not names:
        return df
    numbers = df.select(*[(to_float(strip(col(n))) if n in texts else col(n).cast("double")).alias(f"__x{i}")
                          for i, n in enumerate(names)])
    xs = numbers.columns
    if strategy == "mean" or sizes(numbers, []).fit(max_group_rows):
        pick = F.avg if strategy == "mean" else F.median
        stats = numbers.agg(F.struct(*[pick(x).alias(x) for x in xs]).alias("s")).scalar()
        values = [stats.getField(x) for x in xs]
    else:
        values = [quantile_middle(numbers, x, [], "m", max_group_rows=max_group_rows).scalar()
                  for x in xs]
    return df.withColumns({
        n: F.coalesce(col(n).cast(t), v.cast(t)) for n, v in zip(names, values)
        for t in ["string" if n in texts else "double"]})


def _fill_mode(df: DataFrame, name: str) -> DataFrame:
    """Most frequent value, the smallest on ties; counted map-side, then a top-1."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name)).count()
    top = counts.orderBy(F.desc("count"), col(name).asc()).limit(1).select(col(name))
    return df.withColumn(name, F.coalesce(col(name), top.scalar()))


def _targets(df: DataFrame, rule: Mapping) -> list[str]:
    name = rule.get("column", "")
    return df.columns if name == "*" else existing(df, [name])


def handle_nulls(df: DataFrame, rules: Sequence[Mapping], *, null_tokens: Sequence[str] = (),
                 order_by: Sequence[str] = (), max_group_rows: int | None = None) -> Cleaned:
    """Apply rules ``{"column", "strategy", "fill_value"}`` in order; ``*`` means all columns.

    Strategies: fill, mean, median, mode, forward_fill, backward_fill, drop_row. Each
    sees the effect of the rules before it. The fills along the rows need ``order_by``.
    The audit describes the data before filling.
    """
    df = replace_tokens(df, null_tokens)
    audit = null_audit(df)
    order_by = as_list(order_by)
    for strategy, run in groupby(rules, key=lambda r: r.get("strategy", "")):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown null strategy '{strategy}'; supported: {STRATEGIES}")
        run = list(run)
        # Neighbouring rules of one strategy are independent of each other: do them together.
        names = list(dict.fromkeys(n for r in run for n in _targets(df, r)))
        if strategy == "fill":
            for rule in run:
                for n in _targets(df, rule):
                    df = _fill_constant(df, n, rule.get("fill_value", ""))
        elif not names:
            continue
        elif strategy == "drop_row":
            df = with_keys(df, names)
        elif strategy == "mode":
            for n in names:
                df = _fill_mode(df, n)
        elif strategy in ("mean", "median"):
            df = _fill_numbers(df, names, strategy, max_group_rows)
        else:
            if not order_by:
                raise ValueError(f"'{strategy}' needs order_by")
            df = carry_values(df, [n for n in names if n not in order_by], [], order_by,
                              backward=strategy == "backward_fill",
                              max_group_rows=max_group_rows)
    return Cleaned(df, audit)
