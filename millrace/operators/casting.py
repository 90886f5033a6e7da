"""Type casting by rules, with a report of every failed cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import casts
from ..functions.names import as_list, col, require
from ..functions.text import strip

TARGETS = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(),
           "date": T.TimestampNTZType(), "boolean": T.BooleanType()}
ON_ERROR = ("nullify", "keep_original", "drop_row")


class Cast(NamedTuple):
    result: DataFrame
    errors: DataFrame


def _steps(cell: Column, source: T.DataType, target: str, fmt: str | None,
           strip_currency: bool, i: int) -> dict[str, Column]:
    """The columns that parse ``cell``, each built on the one before; the last is the result."""
    if target == "string":
        return {f"__parsed{i}": casts.to_text(cell)}
    if target == "date" and isinstance(source, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {f"__parsed{i}": cell.cast("timestamp_ntz")}
    money = strip_currency and target in ("integer", "float") and isinstance(source, T.StringType)
    text = F.col(f"__text{i}")
    parsed = {
        "integer": lambda: casts.to_integer(text), "float": lambda: casts.to_float(text),
        "date": lambda: casts.to_date(text, fmt), "boolean": lambda: casts.to_boolean(text),
    }[target]()
    return {f"__text{i}": strip(casts.without_currency(cell) if money else cell),
            f"__parsed{i}": parsed}


def cast_types(df: DataFrame, rules: Sequence[Mapping], *, strip_currency: bool = False,
               trim_strings: bool = False, on_error: str = "nullify",
               report_columns: Sequence[str] = ()) -> Cast:
    """Cast columns by rules ``{"column", "target_type", "format"}`` in order.

    Targets: string, integer, float, date, boolean. A cell fails when it is not
    blank and cannot be read as the target. ``on_error``: nullify, keep_original
    (the column stays text) or drop_row. Rules for absent columns are skipped.
    The report has ``report_columns`` to tell the row, then column, original_value,
    target_type and error.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}, got '{on_error}'")
    report_columns = as_list(report_columns)
    require(df, report_columns, "report columns")
    types = {f.name: f.dataType for f in df.schema.fields}
    if trim_strings:
        df = df.withColumns({n: casts.to_text(col(n)) for n, t in types.items()
                             if isinstance(t, T.StringType)})

    # Each rule adds its parsing steps and a failed flag as columns: what several
    # expressions refer to is then computed once.
    rows = df
    now = {c: col(c) for c in df.columns}
    failed: list[Column] = []
    reports: list[Column] = []
    for i, rule in enumerate(rules):
        name, target = rule.get("column", ""), rule.get("target_type", "string")
        if target not in TARGETS:
            raise ValueError(f"unknown target type '{target}'; supported: {sorted(TARGETS)}")
        if name not in now:
            continue
        before, parsed, fail = now[name], F.col(f"__parsed{i}"), F.col(f"__failed{i}")
        fmt = rule.get("format")
        for step, value in _steps(before, types[name], target, fmt, strip_currency, i).items():
            rows = rows.withColumn(step, value)
        types[name] = TARGETS[target]
        if target != "string":
            text = strip(before)
            rows = rows.withColumn(f"__failed{i}", parsed.isNull() & F.coalesce(
                (text != "") & (text != "nan"), F.lit(False)))
            # Rows dropped by an earlier rule are not looked at by later ones.
            seen = reduce(lambda a, f: a & ~f, failed if on_error == "drop_row" else [], fail)
            expected = f" (expected format: {fmt})" if target == "date" else ""
            reports.append(F.when(seen, F.struct(
                F.lit(name).alias("column"), before.cast("string").alias("original_value"),
                F.lit(target).alias("target_type"),
                F.lit("cast_failed" + expected).alias("error"))))
            failed.append(fail)
            if on_error == "keep_original":
                parsed = F.when(fail, before.cast("string")).otherwise(parsed.cast("string"))
                types[name] = T.StringType()
        now[name] = parsed

    parsed_rows = rows
    if on_error == "drop_row" and failed:
        rows = rows.filter(~reduce(lambda a, b: a | b, failed))
    result = rows.select(*[c.alias(n) for n, c in now.items()])
    if not reports:
        reports = [F.lit(None).cast("struct<column:string,original_value:string,"
                                    "target_type:string,error:string>")]
    errors = parsed_rows.select(*[col(c) for c in report_columns],
                                F.explode(F.array_compact(F.array(*reports))).alias("__e"))
    return Cast(result, errors.select(*[col(c) for c in report_columns], "__e.*"))
