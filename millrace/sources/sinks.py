"""Writers: formats, quoting, run summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, functions as F

FORMATS = ("csv", "tsv", "json", "parquet")


def writer(df: DataFrame, fmt: str = "parquet", *, quote_all: bool = False, mode: str = "error"):
    """A configured writer; an unknown format falls back to CSV."""
    fmt = fmt.lower()
    out = df.write.mode(mode)
    if fmt in ("parquet", "json"):
        return out.format(fmt)
    return (out.format("csv").option("header", True).option("escape", '"')
            .option("sep", "\t" if fmt == "tsv" else ",").option("quoteAll", quote_all))


def write(df: DataFrame, path: str, fmt: str = "parquet", *, quote_all: bool = False,
          mode: str = "error") -> dict[str, int | str]:
    """Write one table and report its rows and columns, counted during the write."""
    seen = Observation()
    writer(df.observe(seen, F.count(F.lit(1)).alias("rows")), fmt, quote_all=quote_all,
           mode=mode).save(path)
    return {"output": path, "rows": seen.get["rows"], "columns": len(df.columns)}


def write_outputs(outputs: Mapping[str, DataFrame], folder: str, fmt: str = "parquet",
                  **options) -> list[dict]:
    """Write several results (a table and its reports, say), one folder each."""
    return [write(df, f"{folder}/{name}", fmt, **options) for name, df in outputs.items()]
