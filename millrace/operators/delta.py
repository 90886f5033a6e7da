"""Change detection between two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import as_list, col, require
from ..session import materialize
from .shape import finish, keep_columns
from .union import common_type, union

MODES = {
    "new_only": ("NEW",),
    "changed_only": ("CHANGED",),
    "full_delta": ("NEW", "CHANGED", "DELETED"),
}


def _values(df: DataFrame, compare: Sequence[str]) -> list[Column]:
    """What tells the compared values of two rows apart, equal for equal rows.

    Two 64-bit digests, which hash aggregation keeps in place; a hash passes over nulls, so which
    cells are null is part of what is hashed. Nested values, in which nulls may stand anywhere, are
    kept as they are.
    """
    cells = [col(c) for c in compare]
    if any(isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
           for c in compare):
        return [F.struct(*cells)]
    blank = [F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])] if cells else []
    return [F.xxhash64(F.lit(i), *blank, *cells) for i in range(2)] if cells else []


def key_status(current: DataFrame, baseline: DataFrame, keys: Sequence[str],
               compare: Sequence[str]) -> DataFrame:
    """One row per key that is NEW, CHANGED or DELETED.

    A key is changed when some current row differs from some baseline row, that is
    when the compared values of both sides together are not all equal. Minimum and
    maximum of their 128-bit digests decide that with partial aggregation, so repeated
    keys are never paired with each other.
    """
    def side(df: DataFrame, is_current: bool) -> DataFrame:
        return df.select(
            *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            F.lit(is_current).alias("__cur"),
            *[v.alias(f"__v{i}") for i, v in enumerate(_values(df, compare))])

    both = side(current, True).unionAll(side(baseline, False))
    values = [c for c in both.columns if c.startswith("__v")]
    differ = [F.min(v) != F.max(v) for v in values]
    facts = both.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(
        F.max("__cur").alias("__in_cur"), F.min("__cur").alias("__only_cur"),
        reduce(or_, differ, F.lit(False)).alias("__differs"))
    changed = F.col("__differs")
    status = (F.when(F.col("__only_cur"), "NEW").when(~F.col("__in_cur"), "DELETED")
              .when(changed, "CHANGED"))
    return (facts.withColumn("__status", status).filter("__status is not null")
            .drop("__in_cur", "__only_cur", "__differs"))


def _one_type(current: DataFrame, baseline: DataFrame, columns: Sequence[str],
              ) -> tuple[DataFrame, DataFrame]:
    types = {c: common_type([current.schema[c].dataType, baseline.schema[c].dataType])
             for c in columns}

    def cast(df: DataFrame) -> DataFrame:
        return df.withColumns({c: col(c).cast(t) for c, t in types.items()
                               if df.schema[c].dataType != t})

    return cast(current), cast(baseline)


def delta(current: DataFrame, baseline: DataFrame, keys: Sequence[str], *,
          mode: str = "full_delta", compare: Sequence[str] = (),
          status_column: str = "delta_status", current_columns: Sequence[str] = (),
          baseline_columns: Sequence[str] = (), drop: Sequence[str] = (),
          move: tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``current`` that are NEW or CHANGED and rows of ``baseline`` that are DELETED.

    All current rows of a changed key are returned. Two nulls count as equal. Keys and compared
    columns that differ in type between the snapshots are brought to the type a union gives them.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}'; use {sorted(MODES)}")
    current = keep_columns(current, current_columns)
    baseline = keep_columns(baseline, baseline_columns)
    keys = as_list(keys)
    require(current, keys, "key columns (current)")
    require(baseline, keys, "key columns (baseline)")
    compare = [c for c in (compare or current.columns)
               if c in current.columns and c in baseline.columns and c not in keys]
    current, baseline = _one_type(current, baseline, [*keys, *compare])
    status = key_status(current, baseline, keys, compare)
    wanted = MODES[mode]
    if "DELETED" in wanted:
        # Both sides look keys up: they are compared once, and only differing keys are written.
        status = materialize(status, "status")

    def rows(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
        names = [f"__k{i}" for i in range(len(keys))]
        picked = status.filter(F.col("__status").isin(*kinds))
        on = [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
        return (df.join(picked, on).drop(*names)
                .withColumnRenamed("__status", status_column))

    parts = [rows(current, [k for k in wanted if k != "DELETED"])]
    if "DELETED" in wanted:
        parts.append(rows(baseline, ["DELETED"]))
    return finish(union(parts), drop, move)
