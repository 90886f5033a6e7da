"""ZIP archives as distributed scans: one task per archive member, read as a stream."""

from __future__ import annotations

import csv
import hashlib
import io
import shutil
import zipfile
from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import col, unique_names
from ..operators.union import union
from ..session import materialize, scratch_path
from .delimited import HEAD_CHARS, sniff
from .files import (DELIMITED, FEW_FILES, MEMBER_TYPES, create_file, each_alone, listing, open_file,
                    per_file)
from .inference import NULL_TOKENS, infer_types
from .structured import read_json, read_xml

# The column that tells an unpacked member's file.
FILE = "__unpacked"
# Python-to-Arrow batch size for streamed lines.
BATCH_LINES = 4096
# White space that makes a blank line, in any encoding.
BLANK = " \t\v\f\r\n"


def members(spark: SparkSession, path: str | Sequence[str] | DataFrame, *,
            skip_extensions: Sequence[str] = (), without: DataFrame | None = None) -> DataFrame:
    """(path, archive, member, name, ext, bytes, position) of every file in the archives, but for
    archives whose ``path`` is in ``without``.

    ``path`` is one archive, several, a listing of them, or a folder whose ``.zip`` files are all taken.
    Only the archives' tables of contents are read.
    """
    skipped = {e.lower().lstrip(".") for e in skip_extensions}

    def contents(path: str):
        with open_file(path) as fh, zipfile.ZipFile(fh) as z:
            for i, info in enumerate(z.infolist()):
                name = info.filename.rsplit("/", 1)[-1]
                ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                if name and ext not in skipped:
                    yield info.filename, name, ext, info.file_size, i

    files = listing(spark, path, "*.[zZ][iI][pP]").dropDuplicates(["path"])
    if without is not None:
        files = files.join(without.select("path"), "path", "left_anti")
    found = per_file(files, contents,
                     "member string, name string, ext string, bytes long, position int")
    return found.withColumn("archive", F.element_at(F.split("path", "/"), -1))


def pick(found: DataFrame, name: str | None = None) -> DataFrame:
    """Members of the given base name (case ignored), or each archive's first table file."""
    if name:
        return found.filter(F.lower("name") == name.lower())
    tables = found.filter(F.col("ext").isin(*MEMBER_TYPES))
    first = tables.groupBy("path").agg(F.min("position").alias("position"))
    return tables.join(first, ["path", "position"])


def _is_open(line: str, sep: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line; quotes count where a field begins."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at) + 1
                if at == 0:
                    return False
                continue
            at, inside = at + 1, True
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2                                 # a doubled quote stands for one
        else:
            inside, at = False, line.find(sep, at) + 1
            if at == 0:
                return False


def _records(stream, sep: str):
    """(record, broken): text lines, joined while a quoted field is open.

    A line whose quote is never closed is broken, by itself: the lines after it are given back.
    """
    waiting = iter(stream)
    while True:
        held: list[str] = []
        for line in waiting:
            if '"' in line or held:
                is_open = _is_open(line, sep, bool(held)) if '"' in line else True
                held.append(line)
                if is_open:
                    continue
                line = "".join(held)
                held = []
            yield line.rstrip("\r\n"), False
        if not held:
            return
        yield held[0].rstrip("\r\n"), True
        waiting = iter(held[1:])


# Encodings tried for a member, in this order; Latin-1, which fits any bytes, is the last.
ENCODINGS = ("utf-8", "cp1252")


def _readings(line: str) -> tuple[str | None, ...]:
    """A line read as Latin-1, by each of ``ENCODINGS``; None where its bytes do not allow it."""
    raw, out = line.encode("latin-1"), []
    for encoding in ENCODINGS:
        try:
            out.append(raw.decode(encoding))
        except UnicodeDecodeError:
            out.append(None)
    return tuple(out)


def scanned(z: zipfile.ZipFile, member: str):
    """(sep, line, broken) of every filled record of a member, which is inflated once.

    Lines are given as Latin-1, one character a byte: line ends, quotes and delimiters stand at the
    same places in every encoding, so that it can be settled when the member has been read.
    """
    with io.TextIOWrapper(z.open(member), encoding="latin-1", newline="") as text:
        head: list[str] = []
        size = 0
        for line in text:
            head.append(line if head else line.removeprefix("\xef\xbb\xbf"))
            size += len(line)
            if size >= 4 * HEAD_CHARS:
                break
        sep = sniff("".join(head).encode("latin-1").decode("utf-8", "replace")[:HEAD_CHARS])
        some = False
        for record, broken in _records(chain(head, text), sep):
            if record.strip(BLANK):
                some = True
                yield sep, record, broken
        if not some:
            yield sep, "", False


def _opened(batches):
    """Each member of the batches with its archive open: (zip, path, archive, member, name)."""
    for batch in batches:
        for path, *which in zip(batch["path"], batch["archive"], batch["member"], batch["name"]):
            with open_file(path) as fh, zipfile.ZipFile(fh) as z:
                yield z, path, *which


def _spread(found: DataFrame) -> DataFrame:
    """One unit of work per member, so a large archive is read by many tasks."""
    return each_alone(found.select("path", "archive", "member", "name"), "path", "member")


def _delimited(found: DataFrame) -> DataFrame:
    return found.filter(F.col("ext").isin(*DELIMITED))


def member_lines(found: DataFrame) -> DataFrame:
    """(path, archive, member, name, sep, line_no, line, broken): the filled records of delimited
    members. The header is line 0, empty in an empty member; a broken line has a quote that is
    never closed.

    Each member is inflated once and its lines are written to the scratch folder with what they
    read as in each encoding; the first encoding that fits all lines of a member is then taken.
    """
    import pandas as pd

    names = ["path", "archive", "member", "name", "sep", "line_no", "line", "broken"]
    read_as = [f"as{i}" for i in range(len(ENCODINGS))]

    def run(batches):
        for z, path, archive, member, name in _opened(batches):
            for start, held in _batched(scanned(z, member)):
                seps, lines, broken = zip(*held)
                frame = pd.DataFrame({"path": path, "archive": archive, "member": member,
                                      "name": name, "sep": seps, "line_no": range(start, start + len(lines)),
                                      "line": lines, "broken": broken})[names]
                # A line of ASCII reads the same in all encodings and is kept once.
                plain = [line.isascii() for line in lines]
                read = [(None,) * len(ENCODINGS) if p else _readings(line)
                        for p, line in zip(plain, lines)]
                for i, c in enumerate(read_as):
                    frame[c] = pd.Series([r[i] for r in read], dtype=object)
                frame["fits"] = [sum(1 << i for i, x in enumerate(r) if p or x is not None)
                                 for p, r in zip(plain, read)]
                yield frame

    lines = materialize(_spread(_delimited(found)).mapInPandas(
        run, "path string, archive string, member string, name string, sep string, line_no long, "
        f"line string, broken boolean, {', '.join(f'{c} string' for c in read_as)}, fits int"), "lines")
    # Members that the first encoding does not fit; few, if any, have to be told apart.
    odd = lines.groupBy("path", "member").agg(F.bit_and("fits").alias("all")).where("(all & 1) = 0")
    text = F.when(F.col("all").isNull(), F.coalesce(read_as[0], "line"))
    for i, c in enumerate(read_as[1:], 1):
        text = text.when(F.col("all").bitwiseAND(1 << i) > 0, F.coalesce(c, "line"))
    return lines.join(odd, ["path", "member"], "left").withColumn(
        "line", text.otherwise(F.col("line"))).select(*names)


def member_heads(lines: DataFrame) -> DataFrame:
    """(path, archive, member, name, sep, header) of the members whose ``member_lines`` are given."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = batch.drop(columns="line")
            out["header"] = pd.Series([next(csv.reader([line], delimiter=sep), [])
                                       for sep, line in zip(batch["sep"], batch["line"])], dtype=object)
            yield out

    return lines.where("line_no = 0").select("path", "archive", "member", "name", "sep", "line").mapInPandas(
        run, "path string, archive string, member string, name string, sep string, header array<string>")


def _batched(records):
    start, held = 0, []
    for record in records:
        held.append(record)
        if len(held) == BATCH_LINES:
            yield start, held
            start, held = start + len(held), []
    if held:
        yield start, held


def _parsed(found: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """For each header its names and the lines under it as ``__r``, with archive and member.

    A member's header is told once; only headers come to the driver. The archives are unpacked
    by one pass; the lines are parsed by Spark.
    """
    lines = member_lines(found)
    heads = materialize(member_heads(lines), "heads")
    kinds = heads.select("sep", "header").distinct().orderBy("sep", "header").collect()
    out = []
    for r in kinds:
        names = unique_names([h or f"Unnamed: {i}" for i, h in enumerate(r["header"])])
        rows = lines.filter("line_no > 0")
        if len(kinds) > 1:
            mine = heads.filter((F.col("sep") == r["sep"]) & (
                F.col("header") == F.array(*map(F.lit, r["header"])) if r["header"]
                else F.size("header") == 0)).select("path", "member")
            rows = rows.join(mine, ["path", "member"], "left_semi")
        schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
        out.append((names, rows.withColumn(
            "__r", F.from_csv("line", schema, {"sep": r["sep"], "escape": '"'}))))
    return out


def archive_bad_lines(found: DataFrame) -> DataFrame:
    """(archive, member, line_no, line) of the lines with more fields than their header, and of
    those with a quote that is never closed."""
    parts = [rows.filter(F.col("broken") | F.col("__r").getField(f"c{len(names)}").isNotNull())
             .select("archive", "member", "line_no", "line") for names, rows in _parsed(found)]
    if not parts:
        raise ValueError("no delimited member to read")
    return reduce(DataFrame.unionByName, parts)


def read_members(found: DataFrame, *, infer: bool = True, source_column: str | None = None,
                 member_column: str | None = None, null_tokens: Sequence[str] = ()) -> DataFrame:
    """Delimited members, stacked into one table by column name.

    Lines with more fields than their header are left out; ``archive_bad_lines`` lists them.
    """
    tokens = [*NULL_TOKENS, *null_tokens]
    extra = {source_column: "archive", member_column: "name"}
    parts = []
    for names, rows in _parsed(found):
        rows = rows.filter(~F.col("broken") & F.col("__r").getField(f"c{len(names)}").isNull())
        cells = [F.col("__r").getField(f"c{i}") for i in range(len(names))]
        parts.append(rows.select(*[F.when(~c.isin(*tokens), c).alias(n) for c, n in zip(cells, names)],
                                 *[F.col(c).alias(n) for n, c in extra.items() if n]))
    if not parts:
        raise ValueError("no delimited member to read")
    table = parts[0] if len(parts) == 1 else union(parts)
    if not infer:
        return table
    types = dict(infer_types(table.drop(*[n for n in extra if n])).dtypes)
    return table.select(*[col(c).try_cast(types[c]).alias(c) if c in types else col(c)
                          for c in table.columns])


def unpack(found: DataFrame, folder: str) -> DataFrame:
    """Write members out as files of one ``folder``, however many archives they come from, and
    return their (file, archive, member, path, bytes); ``file`` is the name there.

    Each member is streamed by its own task; whole-document readers can then use the folder.
    """
    import pandas as pd

    columns = ["file", "archive", "member", "path", "bytes"]

    def run(batches):
        rows = []
        for z, path, archive, member, _ in _opened(batches):
            file = "m" + hashlib.md5(f"{path}\0{member}".encode("utf-8", "surrogatepass")).hexdigest()
            with z.open(member) as source, create_file(f"{folder}/{file}") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            rows.append((file, archive, member, f"{folder}/{file}", z.getinfo(member).file_size))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return materialize(_spread(found).mapInPandas(
        run, "file string, archive string, member string, path string, bytes long").distinct(), "members")


def read_archive(spark: SparkSession, path: str | Sequence[str], member: str | None = None, *,
                 infer: bool = True, source_column: str | None = None,
                 skip_extensions: Sequence[str] = (), null_tokens: Sequence[str] = ()) -> DataFrame:
    """One member of each archive as a table: the named one, or the first table file.

    All archives are read by the same scan and stacked, which is also the union of one
    member over many archives. An archive lacking the named member is an error.
    """
    found = materialize(members(spark, path, skip_extensions=skip_extensions), "members")
    chosen = pick(found, member)
    lacking = found.select("path").distinct().join(chosen.select("path").distinct(), "path",
                                                   "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"member {member or '(any table)'!r} not found in: "
                         f"{[r['path'] for r in lacking]}")
    return stacked_members(spark, chosen, infer=infer, source_column=source_column,
                    null_tokens=null_tokens)


def stacked_members(spark: SparkSession, chosen: DataFrame, *, infer: bool,
             source_column: str | None = None, null_tokens: Sequence[str] = ()) -> DataFrame:
    """Members of any readable formats, stacked by column name."""
    kinds = {r["ext"] for r in chosen.select("ext").distinct().collect()}
    if odd := sorted(kinds - set(MEMBER_TYPES)):
        raise ValueError(f"cannot read members of type {odd}")
    parts = []
    if kinds & set(DELIMITED):
        parts.append(read_members(_delimited(chosen), infer=infer, source_column=source_column,
                                  null_tokens=null_tokens))
    for kind, read in (("json", read_json), ("xml", read_xml)):
        if kind not in kinds:
            continue
        # All members are read together; a row's file tells its archive.
        folder = scratch_path(spark, "unpacked")
        done = unpack(chosen.filter(F.col("ext") == kind), folder)
        where = done if kind == "json" and done.count() > FEW_FILES else folder
        if not source_column:
            parts.append(read(spark, where))
            continue
        table = read(spark, where, {FILE: F.col("_metadata.file_name")})
        archive = done.select(F.col("file").alias(FILE), F.col("archive").alias(source_column))
        parts.append(table.join(archive, FILE).drop(FILE))
    return parts[0] if len(parts) == 1 else union(parts)


def archive_tables(spark: SparkSession, path: str | Sequence[str], *, infer: bool = True,
                   source_column: str | None = None,
                   skip_extensions: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every table member on its own, by member name; members of one name are stacked."""
    found = materialize(members(spark, path, skip_extensions=skip_extensions), "members")
    tables = found.filter(F.col("ext").isin(*MEMBER_TYPES))
    names = [r["name"] for r in tables.select("name").distinct().orderBy("name").collect()]
    return {n: stacked_members(spark, tables.filter(F.col("name") == n), infer=infer,
                        source_column=source_column) for n in names}


def union_members(spark: SparkSession, path: str | Sequence[str], names: Sequence[str] = (), *,
                  infer: bool = True, source_column: str | None = None) -> DataFrame:
    """All table members of the archives, or those of the given base names, stacked by name."""
    found = materialize(members(spark, path), "members").filter(F.col("ext").isin(*MEMBER_TYPES))
    if names:
        found = found.filter(F.lower("name").isin(*[n.lower() for n in names]))
    return stacked_members(spark, found, infer=infer, source_column=source_column)
