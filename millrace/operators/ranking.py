"""Ranking within groups or globally, with top-N and the rows cut off."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import as_list, col, require
from ..plans.ordered import METHODS, number, ordering

# A global top-N up to this size is sorted in one task and broadcast.
SMALL_TOP = 10_000


class Ranked(NamedTuple):
    result: DataFrame
    discarded: DataFrame | None


def _group_limit(df: DataFrame) -> int:
    """Largest N for which Spark prunes each group to N rows before the shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def _top_values(df: DataFrame, rank_by: str, keys: Sequence[str], out: str, method: str,
                ascending: bool, n: int) -> DataFrame:
    """Table (keys, value, rank) of the values ranked at most ``n``.

    The values of the first N rows (distinct values for dense_rank) decide both
    which values qualify and their ranks, so at most N rows per group are kept.
    """
    by_keys = [col(k) for k in keys]
    values = df.select(*by_keys, col(rank_by).alias("__v"))
    if method == "dense_rank":
        values = values.distinct()
    order = ordering(F.col("__v"), ascending)
    w = Window.partitionBy(*by_keys).orderBy(order)
    if keys:
        top = values.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n).drop("__i")
    else:
        top = values.orderBy(order).limit(n)
    return top.withColumn(out, getattr(F, method)().over(w).cast("long")).distinct()


def _top(df: DataFrame, rank_by: str, keys: Sequence[str], out: str, method: str,
         ascending: bool, n: int, order_by: Sequence[str], max_group_rows: int | None) -> DataFrame:
    by_keys = [col(k) for k in keys]
    if n > (_group_limit(df) if keys else SMALL_TOP):
        ranked = number(df, rank_by, keys, out, method=method, ascending=ascending,
                        order_by=order_by, max_group_rows=max_group_rows)
        return ranked.filter(col(out) <= n)
    if method == "row_number":
        order = [ordering(col(rank_by), ascending), *[col(o).asc_nulls_first() for o in order_by]]
        rows = df if keys else df.orderBy(*order).limit(n)
        w = Window.partitionBy(*by_keys).orderBy(*order)
        ranked = rows.withColumn(out, F.row_number().over(w)).filter(col(out) <= n)
        return ranked.withColumn(out, col(out).cast("long"))
    # Ties share a rank and may be many: join them to the few values that qualify.
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    top = _top_values(df, rank_by, keys, out, method, ascending, n).withColumnsRenamed(names)
    if not keys:
        top = F.broadcast(top)
    on = [col(k).eqNullSafe(F.col(m)) for k, m in names.items()]
    on.append(col(rank_by).eqNullSafe(F.col("__v")))
    return df.join(top, on).select(*[col(c) for c in df.columns], col(out))


def rank_rows(df: DataFrame, rank_by: str, partition_by: Sequence[str] = (), *,
              ascending: bool = False, method: str = "row_number", top_n: int = 0,
              rank_column: str = "rank", order_by: Sequence[str] = (), discard: bool = False,
              max_group_rows: int | None = None) -> Ranked:
    """Rank rows and optionally keep ranks up to ``top_n`` (0 keeps all).

    Nulls rank last in both directions. ``row_number`` needs ``order_by`` to settle
    ties; ``rank`` and ``dense_rank`` keep all rows of a tie. With ``discard`` the
    rows beyond ``top_n`` are returned as well.
    """
    keys, order_by = as_list(partition_by), as_list(order_by)
    if method not in METHODS:
        raise ValueError(f"unknown method '{method}'; supported: {METHODS}")
    require(df, [rank_by], "rank column")
    require(df, [*keys, *order_by], "partition and order columns")
    if method == "row_number" and not order_by:
        raise ValueError("row_number needs order_by to settle ties")
    if rank_column in df.columns:
        if rank_column in (rank_by, *keys, *order_by):
            raise ValueError(f"rank column '{rank_column}' would replace an input of the ranking")
        df = df.drop(rank_column)
    if top_n > 0 and not discard:
        return Ranked(_top(df, rank_by, keys, rank_column, method, ascending, top_n, order_by,
                           max_group_rows), None)
    ranked = number(df, rank_by, keys, rank_column, method=method, ascending=ascending,
                    order_by=order_by, max_group_rows=max_group_rows)
    if top_n <= 0:
        return Ranked(ranked, None)
    return Ranked(ranked.filter(col(rank_column) <= top_n),
                  ranked.filter(col(rank_column) > top_n))
