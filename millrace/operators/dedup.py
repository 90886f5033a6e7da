"""Duplicate removal by key, and the report of all duplicated rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import as_list, col, require, unused


class Deduplicated(NamedTuple):
    result: DataFrame
    duplicates: DataFrame


def keep_one(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
             keep: str = "first") -> DataFrame:
    """First or last row of each key in ``order_by`` order.

    The ``= 1`` filter lets Spark cut every key to one row per task before the
    shuffle, so a hot key costs no more than any other.
    """
    keys, order_by = as_list(keys), as_list(order_by)
    if not order_by:
        raise ValueError("keep='first' and 'last' need order_by: Spark rows have no order")
    require(df, [*keys, *order_by], "columns")
    order = [col(o).desc_nulls_last() if keep == "last" else col(o).asc_nulls_first()
             for o in order_by]
    n = unused(df, "n")
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn(n, F.row_number().over(w)).filter(col(n) == 1).drop(n)


def keep_unrepeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key occurs once; keys are merged map-side, never gathered."""
    return _by_count(df, as_list(keys), "__n = 1")


def _by_count(df: DataFrame, keys: Sequence[str], which: str) -> DataFrame:
    """The rows whose key occurs as often as ``which`` says: a hash count, then a semi join."""
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    chosen = (df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
              .filter(which).drop("__n").withColumnsRenamed(names))
    return df.join(chosen, [col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "left_semi")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    keys = as_list(keys)
    require(df, keys, "key columns")
    return _by_count(df, keys, "__n > 1")


def deduplicate(df: DataFrame, keys: Sequence[str], keep: str = "first",
                order_by: Sequence[str] = ()) -> Deduplicated:
    """Drop duplicates on ``keys``: ``first``, ``last``, or ``none`` to drop all members."""
    if keep not in ("first", "last", "none"):
        raise ValueError(f"unknown keep '{keep}'; use first, last or none")
    require(df, as_list(keys), "key columns")
    result = (keep_one(df, keys, order_by, keep) if keep in ("first", "last")
              else keep_unrepeated(df, keys))
    return Deduplicated(result, duplicate_rows(df, keys))
