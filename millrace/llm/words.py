"""Arrow batches of texts as numbered words; used inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from millrace.session import ship, tune

BLOCK_BYTES = 4 << 20
# Whole texts travel in batches: fewer rows than usual keep a batch to a few MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
         "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def prepared(spark: SparkSession) -> SparkSession:
    """Settings for operators on texts, and this package for the Python workers."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return ship(tune(spark))


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task, after which the worker gives back the memory it has freed.

    Workers are kept for later tasks. The allocators of Arrow and of C would hold on to what large
    texts took, beside whatever runs next on the executor.
    """
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):         # of glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return task


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty texts."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``most`` bytes (one text at least), with their first position."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, and each text's bounds among them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not filled.all():
        flat = flat.filter(pa.array(filled))
        bounds = np.concatenate([[0], np.cumsum(filled)])[bounds]
    return flat, bounds.astype(np.int64)


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the different words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of ``values`` within each pair of neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's bounds in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]
