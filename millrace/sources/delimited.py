"""Delimited text: delimiter, encoding and quoting are detected per file; files of
the same layout are then read together by one scan."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import col, unique_names
from ..session import materialize
from .files import FEW_FILES, file_name, listing, open_file, per_file
from .inference import NULL_TOKENS, blank_to_null, infer_types
from .ranges import Lines, Quotes, records

DELIMITERS = ",|\t;"
HEAD_CHARS = 8192
OVERFLOW = "__overflow"
# A quote where a field begins.
OPENING = '(^|[,|\\t;]) *"'

# The bytes 0x80-0x9f are where cp1252 differs from latin-1; five of them are undefined.
_HIGH = [bytes([b]) for b in range(0x80, 0xA0)]
CP1252_UNDEFINED = [b for b in _HIGH if not b.decode("cp1252", "ignore")]
CP1252_FROM = "".join(b.decode("latin-1") for b in _HIGH if b not in CP1252_UNDEFINED)
CP1252_TO = "".join(b.decode("cp1252") for b in _HIGH if b not in CP1252_UNDEFINED)


class Layout(NamedTuple):
    sep: str
    encoding: str
    multi_line: bool
    header: tuple[str, ...]
    # The files; where they are many a listing of them, and the lines under their headers.
    paths: tuple[str, ...] | DataFrame
    lines: DataFrame | None = None


class Delimited(NamedTuple):
    result: DataFrame
    bad_lines: DataFrame


def sniff(head: str) -> str:
    """Delimiter of a text sample, comma when none stands out."""
    try:
        return csv.Sniffer().sniff(head, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


HEAD_SCHEMA = "sep string, header array<string>, header_bytes array<string>"


def first_record(text: str, sep: str) -> list[str]:
    """The cells of the first record that is not blank."""
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    return next((r for r in rows if any(c.strip() for c in r)), [])


def _has_record(raw: bytes) -> bool:
    """Whether the first filled line has ended, outside quotes."""
    lines = raw.removeprefix(b"\xef\xbb\xbf").lstrip(b"\r\n ")
    return b"\n" in lines and lines.split(b"\n", 1)[0].count(b'"') % 2 == 0


def _heads(path: str, sep: str | None = None):
    """The delimiter and the header, read as UTF-8 and byte by byte."""
    with open_file(path) as fh:
        raw = fh.read(4 * HEAD_CHARS)
        head = raw.decode("utf-8-sig", "replace")[:HEAD_CHARS]
        sep = sep or sniff(head)
        # The header may be longer than the sample: read on until its record ends.
        while not _has_record(raw):
            more = fh.read(4 * HEAD_CHARS)
            if not more:
                break
            raw += more
    yield (sep, first_record(raw.decode("utf-8-sig", "replace"), sep),
           first_record(raw.decode("latin-1"), sep))


def _header(encoding: Column) -> Column:
    """The header as the file's encoding has it."""
    legacy = F.transform("header_bytes", lambda h: F.translate(h, CP1252_FROM, CP1252_TO))
    return (F.when(encoding == "cp1252", legacy).when(encoding == "utf-8", F.col("header"))
            .otherwise(F.col("header_bytes")))


def detect(spark: SparkSession, path: str | Sequence[str], sep: str | None = None) -> DataFrame:
    """(path, sep, header, encoding, multi_line) per file.

    The delimiter comes from the head of each file. Encoding and quoted line breaks
    are decided by every line, in one splittable scan merged per file; a quote inside a
    field that does not begin with one (an inch mark) opens nothing.
    """
    lines = (spark.read.text(path if isinstance(path, str) else list(path))
             .select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
                     .alias("path"), "value"))
    return _detected(listing(spark, path), lines, sep)


def _detected(files: DataFrame, lines: DataFrame, sep: str | None, *facts: Column) -> DataFrame:
    """``detect`` for listed files and their lines (path, value), with more ``facts`` of the lines."""
    heads = per_file(files, lambda p: _heads(p, sep), HEAD_SCHEMA)
    raw = F.col("value").cast("binary")
    undefined = F.lit(False)
    for b in CP1252_UNDEFINED:
        undefined = undefined | F.contains(raw, F.lit(b))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = (quotes % 2 == 1) & F.col("value").rlike(OPENING)
    seen = lines.groupBy(F.col("path").alias("__path")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(undefined).alias("undefined"),
        F.bool_or(odd).alias("multi_line"), *facts)
    encoding = (F.when(F.coalesce("utf8", F.lit(True)), "utf-8")
                .when(~F.col("undefined"), "cp1252").otherwise("latin-1"))
    return (heads.join(seen, F.col("path") == F.col("__path"), "left")
            .withColumns({"encoding": encoding, "multi_line": F.coalesce("multi_line", F.lit(False))})
            .drop("__path", "utf8", "undefined").withColumn("header", _header(F.col("encoding"))).drop("header_bytes"))


def _many(spark: SparkSession, files: DataFrame) -> list[Layout]:
    """``layouts`` of listed files. Tasks write the lines of all files to one table, which is then
    looked at and parsed by Spark; only headers reach the driver."""
    rows = materialize(records(spark, files, Lines(), "latin-1"), "lines")
    bytes_ = F.encode("value", "ISO-8859-1").cast("string")
    # The header is the file's first line; it begins in another range if blank lines come before it.
    begin = F.min(F.when(F.col("no") == 0, F.col("low"))).alias("begin")
    found = materialize(_detected(files, rows.withColumn("value", bytes_), None, begin), "layouts")
    kinds = found.groupBy("sep", "header", "encoding", "multi_line").agg(
        F.min("path").alias("path"), F.max("begin").alias("begin")).orderBy("path").collect()
    out = []
    for r in kinds:
        header = (F.col("header") == F.array(*map(F.lit, r["header"])) if r["header"]
                  else F.size("header") == 0)
        mine = found.filter((F.col("sep") == r["sep"]) & header & (F.col("encoding") == r["encoding"])
                            & (F.col("multi_line") == r["multi_line"])).select("path", "begin")
        # The files are as many as the lines are long: they are not to be gathered for a broadcast.
        own = (rows.join(mine.hint("merge"), "path") if len(kinds) > 1 or r["begin"]
               else rows.withColumn("begin", F.lit(0)))
        lines = own.filter((F.col("no") > 0) | (F.col("low") > F.col("begin"))).select(
            "path", (bytes_ if r["encoding"] == "utf-8" else F.col("value")).alias("value"))
        out.append(Layout(r["sep"], r["encoding"], r["multi_line"], tuple(r["header"]),
                          files.join(mine.select("path"), "path", "left_semi"), lines))
    return out


def layouts(spark: SparkSession, path: str | Sequence[str] | DataFrame, *, sep: str | None = None,
            encoding: str | None = None, multi_line: bool | None = None) -> list[Layout]:
    """Files grouped by layout; only file names and headers reach the driver, of a listing that was
    made by tasks only headers.

    With ``encoding`` and ``multi_line`` given, only the heads of the files are read.
    """
    if isinstance(path, DataFrame):
        return _many(spark, path)
    known = encoding is not None and multi_line is not None
    heads = lambda p: _heads(p, sep)
    found = (per_file(listing(spark, path), heads, HEAD_SCHEMA).withColumns(
        {"encoding": F.lit(encoding), "multi_line": F.lit(multi_line),
         "header": _header(F.lit(encoding))}) if known else detect(spark, path, sep))
    grouped = found.groupBy("sep", "header", "encoding", "multi_line").agg(
        F.sort_array(F.collect_list("path")).alias("paths"))
    return sorted((Layout(r["sep"], encoding or r["encoding"],
                          r["multi_line"] if multi_line is None else multi_line,
                          tuple(r["header"]), tuple(r["paths"])) for r in grouped.collect()),
                  key=lambda layout: layout.paths)


def _read_split(spark: SparkSession, layout: Layout, schema: str, source_column: str | None,
                range_bytes: int | None) -> DataFrame:
    """Files with line breaks inside quotes, split over tasks by byte ranges.

    The header is the first record; it may begin in any range if blank lines come before it.
    """
    # The header, the types and the rows are found by passes of their own; Python runs once.
    few = isinstance(layout.paths, tuple)
    rows = materialize(records(spark, list(layout.paths) if few else layout.paths, Quotes(layout.sep),
                               layout.encoding, range_bytes), "records")
    heads = rows.groupBy("path").agg(F.min(F.struct("low", "no")).alias("head"))
    body = rows.join(F.broadcast(heads) if few and len(layout.paths) <= FEW_FILES else heads, "path").where(
        F.struct("low", "no") > F.col("head"))
    name = F.url_decode(F.replace(file_name(), F.lit("+"), F.lit("%2B")))
    return _parsed(body, layout, schema, source_column, name)


def _parsed(lines: DataFrame, layout: Layout, schema: str, source_column: str | None,
            name: Column) -> DataFrame:
    options = {"sep": layout.sep, "escape": '"', "nullValue": "", "emptyValue": ""}
    return lines.select(F.from_csv("value", schema, options).alias("__r"),
                        *([name.alias(source_column)] if source_column else [])).select(
        "__r.*", *([source_column] if source_column else []))


def read_layout(spark: SparkSession, layout: Layout, *, infer: bool = True,
                columns: Sequence[str] = (), null_tokens: Sequence[str] = (),
                source_column: str | None = None, range_bytes: int | None = None) -> Delimited:
    """Read all files of one layout. Lines with too many fields are set aside, short
    lines are filled with nulls. Files with line breaks inside quotes are read in ranges of
    ``range_bytes``."""
    names = unique_names([h if h else f"Unnamed: {i}" for i, h in enumerate(layout.header)])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, OVERFLOW])
    if layout.multi_line:
        raw = _read_split(spark, layout, schema, source_column, range_bytes)
    elif layout.lines is not None:
        raw = _parsed(layout.lines, layout, schema, source_column, file_name())
    else:
        raw = (spark.read.schema(schema).option("header", True).option("sep", layout.sep)
               .option("encoding", "UTF-8" if layout.encoding == "utf-8" else "ISO-8859-1")
               .option("enforceSchema", True)
               .option("escape", '"').option("nullValue", "").option("emptyValue", "")
               .csv(list(layout.paths)))
        if source_column:
            raw = raw.withColumn(source_column, F.url_decode("_metadata.file_name"))
    if layout.encoding == "cp1252" and not layout.multi_line:
        raw = raw.withColumns({n: F.translate(col(n), CP1252_FROM, CP1252_TO) for n in names})
    good = raw.filter(F.col(OVERFLOW).isNull()).drop(OVERFLOW)
    bad = raw.filter(F.col(OVERFLOW).isNotNull())
    if columns:
        keep = [n for n in good.columns if n in columns or n == source_column]
        good = good.select(*[col(n) for n in keep])
    good = blank_to_null(good, (*NULL_TOKENS, *null_tokens))
    if infer:
        types = dict(infer_types(good.drop(source_column or "")).dtypes)
        good = good.select(*[col(n).try_cast(types.get(n, "string")).alias(n)
                             for n in good.columns])
    return Delimited(good, bad)


def read_delimited(spark: SparkSession, path: str | Sequence[str], *, sep: str | None = None,
                   encoding: str | None = None, multi_line: bool | None = None,
                   infer: bool = True, types: Mapping[str, str] | None = None,
                   columns: Sequence[str] = (), null_tokens: Sequence[str] = (),
                   range_bytes: int | None = None) -> Delimited:
    """Read files of one header; files of several headers have to be united instead.

    What is not given is detected: the delimiter from each file's head, encoding and
    quoted line breaks by one scan, types by another. ``types`` names column types and
    ``infer=False`` keeps text, which preserves leading zeros; both save the type scan.
    """
    found = layouts(spark, path, sep=sep, encoding=encoding, multi_line=multi_line)
    if not found:
        raise FileNotFoundError(f"no delimited files at {path}")
    headers = {layout.header for layout in found}
    if len(headers) > 1:
        raise ValueError(f"{len(headers)} different headers at {path}; use union_folder")
    parts = [read_layout(spark, layout, infer=False, columns=columns, null_tokens=null_tokens,
                         range_bytes=range_bytes) for layout in found]
    good, bad = parts[0]
    for p in parts[1:]:
        good, bad = good.unionByName(p.result), bad.unionByName(p.bad_lines)
    if types:
        good = good.select(*[col(c).try_cast(types.get(c, "string")).alias(c) for c in good.columns])
    return Delimited(infer_types(good) if infer and not types else good, bad)
