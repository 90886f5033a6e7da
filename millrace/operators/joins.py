"""Null-safe equi-joins: two tables, composite keys, chains, header with detail.

Keys match null to null. The physical join is left to adaptive execution, which
broadcasts by measured size and splits hot keys; ``salt`` spreads a hot key by
hand for plans in which that is not possible.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import as_list, col, require
from .dedup import keep_one
from .shape import finish, keep_columns, prefix_columns

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "outer"}


def _check_types(left: DataFrame, right: DataFrame, pairs) -> None:
    for lk, rk in pairs:
        a, b = left.schema[lk].dataType, right.schema[rk].dataType
        if isinstance(a, T.StringType) != isinstance(b, T.StringType):
            raise ValueError(f"key '{lk}' is {a.simpleString()} but '{rk}' is {b.simpleString()}; "
                             "cast one side first")


def _output_names(left: DataFrame, right: DataFrame, shared: Sequence[str],
                  suffixes: tuple[str, str]) -> tuple[list[str], dict[str, str]]:
    """Suffix only the overlapping non-key columns; refuse ambiguous results."""
    rest = [c for c in right.columns if c not in shared]
    overlap = (set(left.columns) - set(shared)) & set(rest)
    if overlap and not any(suffixes):
        raise ValueError(f"columns overlap but no suffix given: {sorted(overlap)}")
    lefts = [c + suffixes[0] if c in overlap else c for c in left.columns]
    rights = {c: c + suffixes[1] if c in overlap else c for c in rest}
    names = lefts + list(rights.values())
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"the suffixes {suffixes} lead to duplicate columns: {repeated}")
    return lefts, rights


def _spread(big: DataFrame, small: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """Give each row of ``big`` one of ``salt`` slots and repeat ``small`` for every slot."""
    slot = F.pmod(F.xxhash64(F.spark_partition_id(), *[col(c) for c in big.columns]), F.lit(salt))
    return (big.withColumn("__slot_a", slot.cast("int")),
            small.withColumn("__slot_b", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))


def join(left: DataFrame, right: DataFrame, on=None, *, left_on=None, right_on=None,
         how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), salt: int = 0,
         match_nulls: bool = True) -> DataFrame:
    """Join on one or more keys; the same or different key names on the two sides.

    Keys of the same name become one column. With different names the right key is
    dropped, so rows found only on the right keep no key. For keys known to hold no
    nulls ``match_nulls=False`` compares plainly, which lets Spark use bucketed tables.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}, got '{how}'")
    lk, rk = as_list(left_on) or as_list(on), as_list(right_on) or as_list(on)
    if not lk or len(lk) != len(rk):
        raise ValueError(f"left keys {lk} and right keys {rk} must be non-empty and equally many")
    require(left, lk, "left join keys")
    require(right, rk, "right join keys")
    pairs = list(zip(lk, rk))
    _check_types(left, right, pairs)
    shared = [a for a, b in pairs if a == b]
    lefts, rights = _output_names(left, right, shared, suffixes)
    gone = {b for a, b in pairs if a != b and b not in lk and rights.get(b) == b}

    li = {c: f"__l{i}" for i, c in enumerate(left.columns)}
    ri = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    a, b = left.toDF(*li.values()), right.toDF(*ri.values())
    compare = Column.eqNullSafe if match_nulls else Column.__eq__
    match = reduce(and_, [compare(F.col(li[x]), F.col(ri[y])) for x, y in pairs])

    def key(name: str) -> Column:
        own, other = F.col(li[name]), F.col(ri[name])
        return F.coalesce(own, other) if how == "right" else own

    columns = [(key(c) if c in shared else F.col(li[c])).alias(n)
               for c, n in zip(left.columns, lefts)]
    columns += [F.col(ri[c]).alias(n) for c, n in rights.items() if c not in gone]

    x, y, on_slot = a, b, match
    if salt > 1:
        if how == "right":
            y, x = _spread(b, a, salt)
        else:
            x, y = _spread(a, b, salt)
        on_slot = match & F.col("__slot_a").eqNullSafe(F.col("__slot_b"))
    matched = x.join(y, on_slot, "left" if how == "outer" else how).select(*columns)
    if how != "outer":
        return matched
    # A full outer join cannot be split on a hot key; its two halves can.
    known = a.select(*[F.col(li[k]) for k in lk]).distinct()
    only_right = b.join(known, match, "left_anti")
    types = dict(matched.dtypes)
    blank = [(F.col(ri[c]) if c in shared else F.lit(None)).cast(types[n]).alias(n)
             for c, n in zip(left.columns, lefts)]
    return matched.unionByName(only_right.select(
        *blank, *[F.col(ri[c]).alias(n) for c, n in rights.items() if c not in gone]))


def join_tables(left: DataFrame, right: DataFrame, on=None, *, left_on=None, right_on=None,
                how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"),
                left_columns: Sequence[str] = (), right_columns: Sequence[str] = (),
                dedup_right_by: str | None = None, dedup_keep: str = "first",
                dedup_order: Sequence[str] = (), drop: Sequence[str] = (),
                move: tuple[str, str] | None = None, salt: int = 0) -> DataFrame:
    """Project both sides, optionally keep one right row per value, join, drop and reorder."""
    dedup = dedup_right_by if dedup_right_by in right.columns else None
    if dedup:
        right = keep_one(right, [dedup], dedup_order, dedup_keep)
    left, right = keep_columns(left, left_columns), keep_columns(right, right_columns)
    joined = join(left, right, on, left_on=left_on, right_on=right_on, how=how,
                  suffixes=suffixes, salt=salt)
    return finish(joined, drop, move)


def join_chain(base: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Join tables one after another; a step is ``{"table", "on", "how", "suffixes"}``.

    ``how`` defaults to ``left`` and ``suffixes`` to ``("_x", "_y")``.
    """
    for i, step in enumerate(steps, 1):
        if step.get("table") is None or not step.get("on"):
            raise ValueError(f"step {i} needs 'table' and 'on'")
    return reduce(lambda acc, s: join(acc, s["table"], s["on"], how=s.get("how", "left"),
                                      suffixes=s.get("suffixes", ("_x", "_y"))), steps, base)


def denormalize(header: DataFrame, detail: DataFrame, on=None, *, left_on=None, right_on=None,
                how: str = "left", prefix: str = "", suffixes: tuple[str, str] = ("_x", "_y"),
                header_columns: Sequence[str] = (), detail_columns: Sequence[str] = (),
                dedup_detail_by: str | None = None, dedup_keep: str = "first",
                dedup_order: Sequence[str] = (), drop: Sequence[str] = (),
                move: tuple[str, str] | None = None, salt: int = 0) -> DataFrame:
    """Attach detail rows to header rows, detail columns prefixed except the key."""
    if dedup_detail_by in detail.columns:
        detail = keep_one(detail, [dedup_detail_by], dedup_order, dedup_keep)
    detail = keep_columns(detail, detail_columns)
    keys = as_list(right_on) or as_list(on)
    require(detail, keys, "detail join keys")
    return finish(join(keep_columns(header, header_columns), prefix_columns(detail, prefix, keys),
                       on, left_on=left_on, right_on=right_on, how=how, suffixes=suffixes,
                       salt=salt), drop, move)
