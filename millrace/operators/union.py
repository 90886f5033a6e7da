"""Union of tables with differing columns, against a schema or not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.names import col
from .shape import conform, tag_source, with_unique_names


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """Same type: keep; whole numbers: long; mixed numbers: double; anything else: string."""
    kinds = [t for t in dict.fromkeys(types) if not isinstance(t, T.NullType)]
    if len(kinds) <= 1:
        return kinds[0] if kinds else T.StringType()
    if all(isinstance(t, T.IntegralType) for t in kinds):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in kinds):
        return T.DoubleType()
    return T.StringType()


def union(tables: Mapping[str, DataFrame] | Sequence[DataFrame], *, source_tag: str | None = None,
          output_columns=None) -> DataFrame:
    """Stack tables by column name, columns in first-seen order, missing ones null.

    ``source_tag`` names a column that receives each table's name. With
    ``output_columns`` every table is first fitted to that list.
    """
    named = dict(tables) if isinstance(tables, Mapping) else {str(i): t for i, t in enumerate(tables)}
    if not named:
        raise ValueError("no tables to union")
    frames = []
    for name, df in named.items():
        df = conform(with_unique_names(df), output_columns, missing_type="void")
        frames.append(tag_source(df, name, source_tag) if source_tag else df)
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for field in df.schema.fields:
            seen.setdefault(field.name, []).append(field.dataType)
    target = {name: common_type(types) for name, types in seen.items()}

    def fit(df: DataFrame) -> DataFrame:
        own = set(df.columns)
        return df.select(*[(col(n) if n in own else F.lit(None)).cast(t).alias(n)
                           for n, t in target.items()])

    return reduce(DataFrame.unionAll, [fit(df) for df in frames])
