"""File listings and small reads, done as Spark tasks."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, ship

# Extensions a table can be read from, inside and outside archives.
DELIMITED = ("csv", "tsv", "txt")
MEMBER_TYPES = (*DELIMITED, "json", "xml")
FILE_TYPES = (*MEMBER_TYPES, "html", "htm", "parquet", "zip")
# Files or members that one task reads one after the other.
ITEMS = 100
# Rows of several files that a task hands over together.
BATCH_ROWS = 4096
# Files whose names the driver may hold; more are listed and read by tasks.
FEW_FILES = 10_000


def open_file(path: str):
    """Open a path for random reads, local or on any file system Arrow knows."""
    if "://" not in path or path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/")
                    if path.startswith("file:") else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def create_file(path: str):
    """Open a new file for writing from a task, locally or on a file system Arrow knows."""
    if "://" not in path or path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_output_stream(inner)


def file_name() -> Column:
    """The last part of ``path``."""
    return F.element_at(F.split("path", "/"), -1)


def _named() -> tuple[Column, ...]:
    return ("path", file_name().alias("file"),
            F.lower(F.regexp_extract(file_name(), r"\.([^.]*)$", 1)).alias("ext"))


def listing(spark: SparkSession, path: str | Sequence[str] | DataFrame,
            pattern: str | None = None) -> DataFrame:
    """(path, file, ext, bytes, modified) of every file; contents are not read.

    The driver holds the names of all files; a listing that was made by tasks is given back as it is.
    """
    if isinstance(path, DataFrame):
        return path
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return (reader.load(path if isinstance(path, str) else list(path))
            .select("path", "length", "modificationTime")
            .select(*_named(), F.col("length").alias("bytes"),
                    F.col("modificationTime").alias("modified")))


def _hidden(name: str) -> bool:
    """Whether Spark's readers leave out what has this name."""
    return (name.startswith(".") or name.endswith("._COPYING_")
            or name.startswith("_") and "=" not in name)


def _inside(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, whether a folder, bytes) of what lies in a folder, but for what is hidden."""
    if folder.startswith("file:"):
        with os.scandir("/" + folder.removeprefix("file:").lstrip("/")) as found:
            for entry in found:
                try:
                    status = entry.stat()
                except FileNotFoundError:           # a link to nothing
                    continue
                if not _hidden(entry.name):
                    yield entry.name, stat.S_ISDIR(status.st_mode), status.st_size
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    for info in system.get_file_info(fs.FileSelector(inner)):
        if not _hidden(info.base_name):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _partitioned(folder: str) -> bool:
    """Whether Spark would take folders below one, or itself, for partitions."""
    return "=" in folder.rsplit("/", 1)[-1] or any(
        is_folder and _partitioned(f"{folder}/{name}") for name, is_folder, _ in _inside(folder))


def _files(folder: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files right in a folder, and -1 bytes for one below that has partitions."""
    below: list[str] = []
    for name, is_folder, size in _inside(folder):
        if is_folder:
            below.append(f"{folder}/{name}")
        elif size:                                  # Spark lists no empty file either
            yield f"{folder}/{name}", size
    yield from ((path, -1) for path in below if _partitioned(path))


def _plain_folder(spark: SparkSession, path: str) -> str | None:
    """The full name of a folder that tasks can list; None for patterns, files and other stores."""
    from pyarrow import ArrowException, fs

    if set(path) & set("{}[]*?\\"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(place).toString().rstrip("/")
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return None
    if not full.startswith("file:"):
        try:
            fs.FileSystem.from_uri(full.replace("s3a://", "s3://", 1))
        except (ArrowException, OSError, ValueError):
            return None
    return full


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, ext, bytes) of the files of a folder, as ``listing`` has them, listed and written
    by a task: the driver holds none of their names. What is no plain folder is listed by Spark."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for folder in batch["path"]:
                files = _files(folder)
                while held := list(islice(files, BATCH_ROWS)):
                    yield pd.DataFrame(held, columns=["path", "bytes"])

    full = _plain_folder(spark, path)
    if full:
        ship(spark)
        found = materialize(spark.createDataFrame([(full,)], "path string").mapInPandas(
            run, "path string, bytes long"), "files").select(*_named(), "bytes")
        if found.filter("bytes < 0").isEmpty():
            return found
    return materialize(listing(spark, path).drop("modified"), "files")


def per_file(files: DataFrame, read, schema: str) -> DataFrame:
    """Run ``read(path) -> iterable of row tuples`` for every listed file, one task slot each."""
    import pandas as pd

    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        rows = ((path, *row) for batch in batches for path in batch["path"] for row in read(path))
        while held := list(islice(rows, BATCH_ROWS)):
            yield pd.DataFrame(held, columns=["path", *names])

    return each_alone(files.select("path"), "path").mapInPandas(run, f"path string, {schema}")


def each_alone(items: DataFrame, *keys: str) -> DataFrame:
    """Spread a list of files or members over tasks: a few items to a task, and no task idle.

    Whatever runs on them is Python, so the package is sent to the workers here.
    """
    ship(items.sparkSession)
    usual, n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), items.count()
    return items.repartition(max(1, min(n, max(usual, -(-n // ITEMS)))), *keys)
