"""JSON, XML and Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from itertools import chain
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.names import col
from ..operators.shape import flatten
from ..operators.union import union
from ..session import materialize, scratch_path, ship
from .files import create_file, file_name, listing, open_file, per_file
from .inference import nan_to_null
from .ranges import Lines, Nesting, records


def json_forms(spark: SparkSession, path) -> dict[bool, list[str]]:
    """Files by whether they are whole documents (True) or one value a line (False).

    Lines are JSON lines only if every filled one of the file is a JSON value by itself.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("path"), (F.btrim("value") == "").alias("blank"),
        F.try_parse_json("value").isNull().alias("broken"))
    found = lines.groupBy("path").agg(F.bool_or(F.col("broken") & ~F.col("blank")).alias("whole"))
    out: dict[bool, list[str]] = {}
    for r in found.orderBy("path").collect():
        out.setdefault(r["whole"], []).append(r["path"])
    return out


def read_json(spark: SparkSession, path, extra: Mapping[str, Column] | None = None, *,
              multi_line: bool | None = None, range_bytes: int | None = None) -> DataFrame:
    """Objects or arrays of objects, nested objects flattened to dotted columns.

    Whether a file is one document or has one value a line is told from all its lines, unless
    ``multi_line`` says so; files of both forms are stacked by column name. ``extra`` adds
    columns, such as the file name from ``_metadata``. Documents are read in ranges of
    ``range_bytes``. Of a listing that was made by tasks no path comes to the driver.
    """
    if isinstance(path, DataFrame):
        return _read_listed(spark, path, extra or {}, range_bytes)

    def one(paths, whole):
        if whole:
            return nan_to_null(flatten(_json_documents(spark, paths, extra or {}, range_bytes)))
        raw = spark.read.json(paths)
        return nan_to_null(flatten(raw.withColumns(extra) if extra else raw))

    if multi_line is not None:
        return one(path, multi_line)
    forms = json_forms(spark, path)
    if len(forms) <= 1:
        return one(path, next(iter(forms), False))
    return union([one(paths, whole) for whole, paths in sorted(forms.items())])


def _read_listed(spark: SparkSession, files: DataFrame, extra: Mapping[str, Column],
                 range_bytes: int | None) -> DataFrame:
    """``read_json`` of listed files; ``extra`` names columns that receive the file's name."""
    lines = materialize(records(spark, files, Lines(), "latin-1").select(
        "path", F.encode("value", "ISO-8859-1").cast("string").alias("value")), "lines")
    forms = materialize(lines.groupBy("path").agg(
        F.bool_or(F.try_parse_json("value").isNull()).alias("whole")), "forms")
    kinds = [r["whole"] for r in forms.select("whole").distinct().orderBy("whole").collect()]
    parts = []
    for whole in kinds or [False]:
        mine = forms.filter(F.col("whole") == whole).select("path").hint("merge")
        if whole:
            found = records(spark, files.join(mine, "path", "left_semi"), Nesting(), size=range_bytes)
            found = materialize(found.select("path", F.translate("value", "\r\n", "  ").alias("value")),
                                "objects")
        else:
            found = lines.join(mine, "path", "left_semi") if len(kinds) > 1 else lines
        parts.append(nan_to_null(flatten(_values(found, extra))))
    return parts[0] if len(parts) == 1 else union(parts)


def _values(found: DataFrame, extra: Mapping[str, Column]) -> DataFrame:
    """What Spark's reader makes of lines (path, value): a row for each object, also of an array."""
    spark, target = found.sparkSession, scratch_path(found.sparkSession, "objects")
    found.select("value").write.text(target)
    schema = spark.read.json(target).schema
    corrupt = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
    is_list = F.col("value").rlike(r"^\s*\[")
    # An array that is not all objects is one row without values, as with the reader.
    each = F.from_json("value", T.ArrayType(schema))
    each = F.when(F.forall(each, lambda r: r.isNotNull()), each).otherwise(
        F.array(F.lit(None).cast(schema)))
    rows = found.select("path", "value", F.explode(F.when(is_list, each).otherwise(
        F.array(F.from_json("value", schema)))).alias("__r"))
    cells = {f.name: F.col("__r").getField(f.name) for f in schema.fields}
    if corrupt in cells:
        cells[corrupt] = F.when(is_list & F.col("__r").isNull(), F.col("value")).otherwise(cells[corrupt])
    return rows.select(*[c.alias(n) for n, c in cells.items() if n not in extra],
                       *[file_name().alias(n) for n in extra])


def _keys(text: str, path: str):
    """The key paths of a value and what stands there: null (0), an object (1) or another (2).

    What is no object or array of objects is named by its file, which is then like no other.
    """
    try:
        value = json.loads(text)
        open_ = [([], v) for v in (value if isinstance(value, list) else [value])]
        if not all(isinstance(v, dict) for _, v in open_):
            return {path}
    except (ValueError, RecursionError):
        return {path}
    found = {"{}"} if open_ else set()
    while open_:
        at, value = open_.pop()
        for key, inner in value.items():
            kind = 1 if isinstance(inner, dict) else 0 if inner is None else 2
            found.add(json.dumps([kind, *at, key]))
            if kind == 1:
                open_.append(([*at, key], inner))
    return found


def _alike(parts: DataFrame) -> list[list[str]]:
    """Files (``path``) grouped by the set of their different ``part``."""
    sets = parts.groupBy("path").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    found = sets.groupBy("parts").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return sorted(list(r["paths"]) for r in found.select("paths").collect())


def json_alike(spark: SparkSession, path) -> list[tuple[list[str], bool]]:
    """Files with the same keys, and whether they are documents: read together, they have the
    columns that each of them has alone. Files without a value are left out."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            found = {(p, k) for p, text in zip(batch["path"], batch["value"]) if text.strip()
                     for k in _keys(text, p)}
            if found:
                yield pd.DataFrame(sorted(found), columns=["path", "part"])

    ship(spark)
    out = []
    for whole, paths in sorted(json_forms(spark, path).items()):
        rows = (records(spark, paths, Nesting()) if whole else spark.read.text(paths).withColumn(
            "path", F.col("_metadata.file_path"))).select("path", "value")
        out += [(same, whole) for same in _alike(rows.mapInPandas(run, "path string, part string"))]
    return out


def xml_alike(spark: SparkSession, path) -> list[list[str]]:
    """Files with the same shapes of records; those without a record are left out."""
    return _alike(per_file(listing(spark, path), _record_shapes, "part string"))


def _json_documents(spark: SparkSession, paths, extra: Mapping[str, Column],
                    range_bytes: int | None) -> DataFrame:
    """The objects of documents, however many stand in a file, split over tasks by byte ranges.

    Each is written as one line, white space between its parts being free; the lines are then read
    by Spark. ``extra`` names columns that receive the file's name.
    """
    found = records(spark, paths, Nesting(), size=range_bytes)
    line = F.translate("value", "\r\n", "  ").alias("value")
    target = scratch_path(spark, "objects")
    if not extra:
        found.select(line).write.text(target)
        return spark.read.json(target)
    file = F.element_at(F.split("path", "/"), -1)
    found.select(line, file.alias("__name")).write.partitionBy("__name").text(target)
    rows = spark.read.json(target)
    if "__name" not in rows.columns:                # no object at all
        rows = rows.withColumn("__name", F.lit(""))
    name = F.url_decode(F.replace(F.col("__name").cast("string"), F.lit("+"), F.lit("%2B")))
    return rows.withColumns({n: name for n in extra}).drop("__name")


def _footer(path: str):
    import pyarrow.parquet as pq

    with open_file(path) as fh:
        yield (str(pq.read_schema(fh).remove_metadata()),)


def parquet_schemas(spark: SparkSession, path) -> list[list[str]]:
    """Files grouped by the schema in their footers."""
    found = per_file(listing(spark, path).where(~F.col("file").rlike("^[._]")), _footer, "schema string").groupBy("schema").agg(
        F.sort_array(F.collect_list("path")).alias("paths"))
    return sorted(list(r["paths"]) for r in found.collect())


def read_parquet(spark: SparkSession, path) -> DataFrame:
    """All columns of all files: files of one schema are read together, several are stacked."""
    groups = parquet_schemas(spark, path)
    if len(groups) <= 1:
        return nan_to_null(spark.read.parquet(path if isinstance(path, str) else groups[0][0]))
    return nan_to_null(union([spark.read.parquet(*same) for same in groups]))


def _elements(path: str):
    """(depth, number, element) at each end tag; the root's depth is 1, elements are numbered as
    they begin, and what has been read is let go."""
    with open_file(path) as fh:
        open_: list = []
        begun = 0
        for event, element in ElementTree.iterparse(fh, events=("start", "end")):
            if event == "start":
                begun += 1
                open_.append((begun, element))
                continue
            yield len(open_), *open_.pop()
            if len(open_) == 1:
                open_[0][1].clear()


def _record_tags(path: str):
    """The tags of the root's children, and whether one of them also occurs deeper."""
    tags, deeper = set(), set()
    for depth, _, element in _elements(path):
        (tags if depth == 2 else deeper if depth > 2 else set()).add(element.tag)
    if tags:
        yield sorted(tags), len(tags) == 1 and not tags & deeper


class _Shapes:
    """The shapes of a document's records, as XML: their elements with a mark for their text.

    An element's equal children stand at most twice, which tells that they are repeated.
    """

    def __init__(self):
        self.found: set[str] = set()
        self._open: list[tuple[str, list[str], dict[str, int]]] = []

    def start(self, tag, attributes):
        self._open.append((tag, [], {}))

    def text(self, text):
        parts = self._open[-1][1]
        mark = " " if text.isspace() else "x"
        if not parts or parts[-1][0] == "<":
            parts.append(mark)
        elif mark == "x":
            parts[-1] = mark

    def end(self, tag):
        _, parts, _ = self._open.pop()
        shape = f"<{tag}>{''.join(parts)}</{tag}>"
        if len(self._open) == 1:
            self.found.add(shape)
        elif self._open:
            _, outer, seen = self._open[-1]
            seen[shape] = seen.get(shape, 0) + 1
            if seen[shape] <= 2:
                outer.append(shape)


def _record_shapes(path: str):
    shapes = _Shapes()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = shapes.start, shapes.end
    parser.CharacterDataHandler = shapes.text
    with open_file(path) as fh:
        parser.ParseFile(fh)
    return [(shape,) for shape in sorted(shapes.found)]


def _xml(spark: SparkSession, row_tag: str):
    return (spark.read.format("xml").option("rowTag", row_tag)
            .option("inferSchema", False).option("excludeAttribute", True))


def _xml_schema(spark: SparkSession, path, row_tag: str) -> T.StructType:
    """Spark's schema of the records. It follows from their shapes, so Spark is given each shape
    once, in few files: its own pass over many small files runs in one task."""
    import pandas as pd

    folder = scratch_path(spark, "shapes")

    def write(batches):
        shapes = chain.from_iterable(batch["shape"] for batch in batches)
        first = next(shapes, None)
        if first is not None:
            with create_file(f"{folder}/{uuid.uuid4().hex}.xml") as out:
                out.write(b"<all>")
                for shape in chain([first], shapes):
                    out.write(shape.encode() + b"\n")
                out.write(b"</all>")
        yield pd.DataFrame({"done": [1]})

    shapes = per_file(listing(spark, path), _record_shapes, "shape string").select("shape").distinct()
    shapes.mapInPandas(write, "done int").write.format("noop").mode("overwrite").save()
    return _xml(spark, row_tag).load(folder).schema


def row_tags(spark: SparkSession, path) -> dict[str | None, list[str]]:
    """Files by their record tag; under None those whose records differ in tag."""
    tag = F.when(F.col("plain"), F.get("tags", F.lit(0))).alias("tag")
    found = per_file(listing(spark, path), _record_tags, "tags array<string>, plain boolean")
    grouped = found.select("path", tag).groupBy("tag").agg(
        F.sort_array(F.collect_list("path")).alias("paths"))
    return {r["tag"]: list(r["paths"]) for r in grouped.orderBy("tag").collect()}


def _mixed_records(path: str):
    """The texts by tag of each child of the root, taken up as its elements end.

    Of elements of one tag the one that begins last counts.
    """
    begun: dict[str, int] = {}
    texts: dict[str, str] = {}
    for depth, number, element in _elements(path):
        text, tag = element.text or "", element.tag
        if depth > 1 and not (text.isspace() or text == "") and begun.get(tag, 0) < number:
            begun[tag], texts[tag] = number, text
        if depth == 2:
            if texts:
                yield (texts,)
            begun, texts = {}, {}


def _read_mixed(spark: SparkSession, paths, extra: Mapping[str, Column]) -> DataFrame:
    """Every child of the root is a record, whatever its tag; documents are streamed by tasks."""
    rows = per_file(listing(spark, paths), _mixed_records, "texts map<string,string>")
    tags = [r["tag"] for r in rows.select(F.explode(F.map_keys("texts")).alias("tag")).distinct()
            .orderBy("tag").collect()]
    file = F.element_at(F.split("path", "/"), -1)
    return rows.select(*[F.try_element_at("texts", F.lit(t)).alias(t) for t in tags],
                       *[F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))).alias(n) for n in extra])


def _leaves(c: Column, dtype: T.DataType, name: str):
    """(tag, text) of each element below ``c``; of repeated elements the last one."""
    if isinstance(dtype, T.ArrayType):
        yield from _leaves(F.try_element_at(c, F.lit(-1)), dtype.elementType, name)
    elif isinstance(dtype, T.StructType):
        for field in dtype.fields:
            tag = name if field.name == "_VALUE" else field.name
            yield from _leaves(c.getField(field.name), field.dataType, tag)
    else:
        yield name, c.cast("string")


def read_xml(spark: SparkSession, path, extra: Mapping[str, Column] | None = None,
             row_tag: str | None = None) -> DataFrame:
    """One row per child of the root (or per ``row_tag`` element); every descendant tag with text
    is a text column, attributes are ignored and a repeated tag keeps its last value.

    Documents whose records all have one tag are read by Spark's reader, others are streamed.
    """
    if row_tag is None:
        parts = [_read_mixed(spark, same, extra or {}) if tag is None
                 else read_xml(spark, same, extra, tag)
                 for tag, same in row_tags(spark, path).items()]
        if not parts:
            raise ValueError(f"no records at {path}")
        return parts[0] if len(parts) == 1 else union(parts)
    raw = _xml(spark, row_tag).schema(_xml_schema(spark, path, row_tag)).load(path)
    tags: dict[str, list[Column]] = {}
    for field in raw.schema.fields:
        name = row_tag if field.name == "_VALUE" else field.name
        for tag, text in _leaves(col(field.name), field.dataType, name):
            filled = F.when(F.btrim(text) != "", text)
            tags.setdefault(tag, []).append(filled)
    return raw.select(*[F.coalesce(*reversed(cs)).alias(tag) for tag, cs in tags.items()],
                      *[c.alias(n) for n, c in (extra or {}).items()])
