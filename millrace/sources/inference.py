"""Types of an all-text table, found in one aggregation and then applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.casts import NUMBER, WHOLE, to_float
from ..functions.names import col
from ..functions.text import strip

# Cells read as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def blank_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~col(c).isin(*tokens), col(c)) for c in texts}) if texts else df


def infer_types(df: DataFrame) -> DataFrame:
    """Narrow text columns to bigint, double or boolean where every cell allows it.

    Dates stay text and a column of nulls stays text. One pass over the data.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    checks = []
    for i, c in enumerate(texts):
        cell = col(c)
        checks += [
            F.count(cell).alias(f"n{i}"),
            F.count(F.when(cell.rlike(WHOLE), cell.try_cast("bigint"))).alias(f"i{i}"),
            F.count_if(strip(cell).rlike(NUMBER)).alias(f"d{i}"),
            F.count_if(F.lower(cell).isin("true", "false")).alias(f"b{i}"),
        ]
    seen = df.agg(*checks).first()
    out = {}
    for i, c in enumerate(texts):
        n = seen[f"n{i}"]
        if n and seen[f"i{i}"] == n:
            out[c] = col(c).try_cast("bigint")
        elif n and seen[f"d{i}"] == n:
            out[c] = to_float(strip(col(c)))
        elif n and seen[f"b{i}"] == n:
            out[c] = col(c).try_cast("boolean")
    return df.withColumns(out) if out else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: floating NaN becomes null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df
