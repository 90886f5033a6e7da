"""Chaining operators and the join, filter, aggregate, rank composite."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame

from ..functions.names import as_list, col, existing
from ..functions.predicates import filter_rows
from ..operators.aggregate import aggregate, attach_aggregates, attach_top, parse_aggs
from ..operators.joins import join_tables
from ..operators.ranking import SMALL_TOP, rank_rows
from ..operators.shape import finish


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame | tuple]) -> DataFrame:
    """Feed each step's result to the next; the whole chain stays one plan.

    A step that returns a result with reports passes its result on. An error names
    the step it came from.
    """
    for i, step in enumerate(steps, 1):
        try:
            out = step(df)
        except Exception as e:
            e.add_note(f"in step {i}: {getattr(step, '__name__', step)}")
            raise
        df = out[0] if isinstance(out, tuple) else out
    return df


def join_filter_aggregate(
        left: DataFrame, right: DataFrame, on, *, how: str = "inner", where=None,
        group_by: Sequence[str] = (), aggs: Iterable = (), attach: bool = True,
        rank_by: str | None = None, ascending: bool = False, rank_column: str = "rank",
        top_n: int = 0, sort: bool = False, order_by: Sequence[str] = (),
        suffixes: tuple[str, str] = ("_x", "_y"), left_columns: Sequence[str] = (),
        right_columns: Sequence[str] = (), dedup_right_by: str | None = None,
        dedup_keep: str = "first", dedup_order: Sequence[str] = (), drop: Sequence[str] = (),
        move: tuple[str, str] | None = None, max_group_rows: int | None = None) -> DataFrame:
    """Join two tables, filter, aggregate by group, rank by a column and keep the top.

    With ``attach`` the aggregates are added to every joined row and rows are ranked;
    otherwise there is one row per group and groups are ranked. Ties share a rank and
    are all kept.
    """
    joined = join_tables(left, right, on, how=how, suffixes=suffixes, left_columns=left_columns,
                         right_columns=right_columns, dedup_right_by=dedup_right_by,
                         dedup_keep=dedup_keep, dedup_order=dedup_order)
    rows = filter_rows(joined, where)
    aggs, group_by = parse_aggs(aggs), as_list(group_by)
    ranked = False
    if attach and group_by and 0 < top_n <= SMALL_TOP and rank_by in [a.output for a in aggs]:
        result = attach_top(rows, group_by, aggs, rank_by, top_n, ascending=ascending,
                            rank_column=rank_column, order_by=order_by,
                            max_group_rows=max_group_rows)
        ranked = True
    elif attach:
        result = attach_aggregates(rows, group_by, aggs, order_by=order_by,
                                   max_group_rows=max_group_rows)
    else:
        result = aggregate(rows, group_by, aggs or [("*", "size", "_row_count")],
                           order_by=order_by, max_group_rows=max_group_rows)
    if not ranked and rank_by in result.columns:
        result = rank_rows(result, rank_by, method="rank", ascending=ascending, top_n=top_n,
                           rank_column=rank_column, max_group_rows=max_group_rows).result
        ranked = True
    if ranked and sort:
        ties = existing(result, order_by)
        result = result.orderBy(col(rank_column), *[col(o) for o in ties])
    return finish(result, drop, move)
