"""Column profile and run summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.names import col, quoted
from ..session import materialize


NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
# Candidates for a column's top value, and values that a summary of a column keeps count of.
CANDIDATES, TRACKED = 16, 10_000


def _plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, value as text, count) for every distinct non-null value, in one scan.

    The pairs are merged map-side, so a frequent value costs one row per task.
    """
    names = columns or _plain_columns(df)
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
        for c in names])))
    return cells.filter("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns=None) -> DataFrame:
    """(column, top_value, top_count) of each column whose most frequent value is proven.

    A frequent-items summary of each column, merged from all tasks, names ``CANDIDATES`` values; a
    second pass counts these exactly. No cell is shuffled. What a summary does not name occurs at
    most as often as its error bound, or as the least estimate it names: a top count beyond that is
    proven, the smallest value winning a tie. Other columns, such as unique ones, have null for both.
    """
    names = columns or _plain_columns(df)
    found = df.agg(*[F.struct(
        F.expr(f"approx_top_k(cast({quoted(c)} as string), {CANDIDATES}, {TRACKED})").alias("top"),
        F.count(col(c)).alias("n")).alias(f"__s{i}") for i, c in enumerate(names)])
    tops = materialize(found.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__s{i}.top").alias("top"),
                 F.col(f"__s{i}.n").alias("n")) for i, c in enumerate(names)]))), "tops")
    # A summary errs by at most 3.5 / TRACKED of the rows, and leaves out values that it cannot tell
    # from twice that; a little more is allowed for.
    error = F.col("n") * 8 / TRACKED
    least = F.when(F.size("top") >= CANDIDATES, F.array_min(F.transform("top", lambda t: t["count"])))
    bounds = tops.select("column", F.greatest(error, least).alias("bound"))
    # At most CANDIDATES rows a column, whatever the data.
    wanted = tops.select("column", F.explode(F.filter("top", lambda t: t["item"].isNotNull()))
                         .alias("t")).select("column", F.col("t.item").alias("value"))
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names])))
    counts = cells.join(F.broadcast(wanted), ["column", "value"]).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count"))
    best = counts.groupBy("column").agg(F.min(F.struct(
        (-F.col("count")).alias("less"), "value")).alias("best"))
    proven = -F.col("best.less") > F.col("bound")
    return bounds.join(best, "column", "left").select(
        "column", F.when(proven, F.col("best.value")).alias("top_value"),
        F.when(proven, -F.col("best.less")).alias("top_count"))


def _nested(df: DataFrame) -> DataFrame | None:
    """The profile's rows of nested and binary columns, of which only nulls are counted."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NESTED)]
    if not names:
        return None
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(col(c)).alias(f"__n{i}") for i, c in enumerate(names)])
    text = F.lit(None).cast("string")
    return counts.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"__n{i}").alias("n"))
        for i, c in enumerate(names)]))).select(
        "column", "type", F.col("n").alias("non_null"),
        F.round((F.col("__rows") - F.col("n")) / F.col("__rows") * 100, 1).alias("null_pct"),
        F.lit(None).cast("long").alias("unique"), text.alias("min"), text.alias("max"),
        text.alias("top_value"))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, non_null, null_pct, unique, min, max, top_value.

    Minimum, maximum and top value are text; the smallest value wins a tie for the
    top. ``approximate`` replaces the exact distinct counts, and gives the top values that
    ``top_values`` proves without shuffling the cells. Nested and binary columns have a row
    with their type and nulls only.
    """
    rows, nested = _profile(df, approximate), _nested(df)
    return rows if nested is None else nested if rows is None else rows.unionByName(nested)


def _profile(df: DataFrame, approximate: bool) -> DataFrame | None:
    names = _plain_columns(df)
    if not names:
        return None
    types = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        F.struct(F.count(col(c)).alias("n"), F.min(col(c)).cast("string").alias("lo"),
                 F.max(col(c)).cast("string").alias("hi"),
                 (F.approx_count_distinct(col(c)) if approximate else F.lit(None).cast("long"))
                 .alias("u")).alias(f"__s{i}")
        for i, c in enumerate(names)])
    tall = wide.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                 *[F.col(f"__s{i}").getField(f).alias(f) for f in ("n", "lo", "hi", "u")])
        for i, c in enumerate(names)])))
    base = tall.select(
        "column", "type", F.col("n").alias("non_null"),
        F.round((F.col("__rows") - F.col("n")) / F.col("__rows") * 100, 1).alias("null_pct"),
        "u", F.col("lo").alias("min"), F.col("hi").alias("max"))
    if approximate:
        tops = top_values(df, names).select("column", "top_value")
        return base.withColumnRenamed("u", "unique").join(tops, "column", "left")
    counts = value_counts(df, names)
    top = F.min(F.struct(-F.col("count"), F.col("value").alias("v"))).getField("v")
    facts = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), top.alias("top_value"))
    return base.drop("u").join(facts, "column", "left").select(
        "column", "type", "non_null", "null_pct",
        F.coalesce("unique", F.lit(0)).alias("unique"), "min", "max", "top_value")


def run_summary(outputs: Mapping[str, DataFrame]) -> DataFrame:
    """Name, row count and column count of each output."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("output"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in outputs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def preview(df: DataFrame, rows: int = 25, width: int = 120) -> DataFrame:
    """The first rows, long texts cut to ``width`` characters."""
    texts = {f.name: F.substring(col(f.name), 1, width) for f in df.schema.fields
             if isinstance(f.dataType, T.StringType)}
    return (df.withColumns(texts) if texts else df).limit(rows)
