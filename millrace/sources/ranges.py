"""Large files read by byte ranges, their records found by an associative scan.

A byte range alone does not know whether it begins inside quotes. So a first pass finds for each
range the state that it ends in for *every* state that it may begin in. Such maps are joined from
left to right, which tells the state that each range really begins in, and a second pass takes the
records that begin in each range, reading on past its end where the last one does. Gathered is one
row of a few numbers for each range, within its file.

For delimited text the state tells whether a record or a field begins, a field is unquoted or
quoted, or a quote was met that closes the field unless it is doubled. For JSON it tells whether a
string is open, whether the next character is escaped, and how deep brackets are nested; the depth
is a sum, so only its change is kept for each range.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from .files import BATCH_ROWS, each_alone, listing, open_file

RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20


def _chunks(path: str, low: int, high: int | None = None) -> Iterator[bytes]:
    with open_file(path) as fh:
        fh.seek(low)
        while high is None or low < high:
            raw = fh.read(CHUNK if high is None else min(CHUNK, high - low))
            if not raw:
                return
            low += len(raw)
            yield raw


class Lines:
    """Lines, whatever stands in them; a carriage return ends one as a line break does. They are to
    be read as Latin-1, one character a byte."""

    starts = range(1)
    # What Spark's readers call a blank line consists of these.
    blank = "".join(map(chr, range(33)))

    def records(self, path: str, low: int, high: int, state: int, depth: int) -> Iterator[bytes]:
        """The lines that begin in the range."""
        with open_file(path) as fh:
            fh.seek(max(low - 1, 0))
            text = io.TextIOWrapper(fh, encoding="latin-1", newline="")
            # The line that the byte before the range belongs to begins before it.
            at = low - 1 + len(text.readline()) if low else 0
            while at < high and (line := text.readline()):
                at += len(line)
                yield line.encode("latin-1")


class Quotes:
    """Records of delimited text. A quote opens a field only where the field begins, a doubled one
    inside stands for itself, and one inside an unquoted field is a character like others."""

    RECORD, FIELD, PLAIN, QUOTED, CLOSING = range(5)
    starts = range(5)
    blank = None

    def __init__(self, sep: str):
        self.sep = sep.encode()

    def _run(self, raw: bytes, state: int, at: int = 0, breaks: list[int] | None = None) -> int:
        """The state after ``raw``; the places after line breaks outside quotes go to ``breaks``."""
        i, n = 0, len(raw)
        before = b"\n" if state == self.RECORD else self.sep if state == self.FIELD else b""
        while i < n:
            if state == self.QUOTED:
                i = raw.find(b'"', i) + 1
                if not i:
                    return self.QUOTED
                state = self.CLOSING
            elif state == self.CLOSING and raw[i:i + 1] == b'"':
                state, i = self.QUOTED, i + 1
            else:
                quote = raw.find(b'"', i)
                end = quote if quote >= 0 else n
                if breaks is not None:
                    breaks += [at + i + m.end() for m in re.finditer(b"\n", raw[i:end])]
                last = raw[end - 1:end] if end > i else before if not i else b""
                if quote < 0:
                    return {b"\n": self.RECORD, self.sep: self.FIELD}.get(last, self.PLAIN)
                state = self.QUOTED if last in (b"\n", self.sep) else self.PLAIN
                i = quote + 1
        return state

    def summary(self, path: str, low: int, high: int) -> list[int]:
        ends = list(self.starts)
        for raw in _chunks(path, low, high):
            ends = [self._run(raw, s) for s in ends]
        return ends + [0] * len(ends)

    def records(self, path: str, low: int, high: int, state: int, depth: int) -> Iterator[bytes]:
        """The records that begin in the range."""
        held, at = (b"" if state == self.RECORD else None), low
        for raw in _chunks(path, low):
            breaks: list[int] = []
            state = self._run(raw, state, at, breaks)
            begin = at
            for to in breaks:
                if held is not None:
                    yield held + raw[begin - at:to - at]
                held, begin = b"", to
                if to >= high:
                    return
            if held is None and at + len(raw) >= high:
                return
            if held is not None:
                held += raw[begin - at:]
            at += len(raw)
        if held:
            yield held


class Nesting:
    """Objects of JSON documents: the elements of outermost arrays, or objects one after the other."""

    OUT, STRING, ESCAPED = range(3)
    starts = range(3)
    blank = None
    _mark = re.compile(rb'["{}\[\]]')
    _end = re.compile(rb'["\\]')

    def _run(self, raw: bytes, state: int, seen=None) -> tuple[int, int]:
        """The state after ``raw`` and the change of depth; ``seen(place, mark, change)`` is told
        of brackets."""
        i, n, depth = 0, len(raw), 0
        while i < n:
            if state == self.ESCAPED:
                state, i = self.STRING, i + 1
            elif state == self.STRING:
                m = self._end.search(raw, i)
                if not m:
                    break
                state, i = (self.OUT if m[0] == b'"' else self.ESCAPED), m.end()
            else:
                m = self._mark.search(raw, i)
                if not m:
                    break
                i = m.end()
                if m[0] == b'"':
                    state = self.STRING
                else:
                    opens = m[0] in b"{["
                    depth += 1 if opens else -1
                    if seen and not seen(m.start(), m[0], depth):
                        break
        return state, depth

    def summary(self, path: str, low: int, high: int) -> list[int]:
        ends, depths = list(self.starts), [0] * len(self.starts)
        for raw in _chunks(path, low, high):
            found = [self._run(raw, s) for s in ends]
            ends, depths = [s for s, _ in found], [d + e for d, (_, e) in zip(depths, found)]
        return ends + depths

    def records(self, path: str, low: int, high: int, state: int, depth: int) -> Iterator[bytes]:
        """The objects that begin in the range; outermost values are all arrays or all objects."""
        head = next(_chunks(path, 0), b"").removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
        level = 1 if head == b"[" else 0
        held: list[bytes] | None = None
        at = low
        for raw in _chunks(path, low):
            done: list[bytes] = []
            begin = 0

            def seen(place, mark, change):
                nonlocal held, begin
                if mark in b"{[":
                    if depth + change == 1 and mark != (b"[" if level else b"{"):
                        raise ValueError(f"arrays and objects side by side in {path}")
                    if mark == b"{" and depth + change == level + 1:
                        if at + place >= high:
                            return False
                        held, begin = [], place
                elif depth + change == level and held is not None and mark == b"}":
                    done.append(b"".join([*held, raw[begin:place + 1]]))
                    held = None
                return held is not None or at + place < high

            state, change = self._run(raw, state, seen)
            yield from done
            depth += change
            at += len(raw)
            if held is not None:
                held.append(raw[begin:])
            elif at >= high:
                return
        if held:
            yield b"".join(held)


def records(spark: SparkSession, path: str | Sequence[str] | DataFrame, automaton,
            encoding: str = "utf-8", size: int | None = None) -> DataFrame:
    """``path, low, no, value``: the filled records of all files as text, by byte ranges.

    ``no`` counts the records that begin in the range at ``low``.
    """
    import pandas as pd

    size = size or RANGE_BYTES
    files = listing(spark, path).select("path", "bytes").where("bytes > 0")
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1,
                                                    F.lit(size).cast("long"))).alias("low"), "bytes")
    cut = cut.select("path", "low", F.least(F.col("low") + size, "bytes").alias("high"))
    kinds = len(automaton.starts)
    columns = ["path", "low", "value", "no"]

    def summarize(batches):
        for batch in batches:
            batch["map"] = [automaton.summary(*r) for r in batch[["path", "low", "high"]].itertuples(
                index=False, name=None)]
            yield batch

    def begin(batches):
        """The states of ranges that come by file, in order."""
        file, state, depth = None, 0, 0
        for batch in batches:
            states, depths = [], []
            for path, ends in zip(batch["path"], batch["map"]):
                if path != file:
                    file, state, depth = path, 0, 0
                states.append(state)
                depths.append(depth)
                state, depth = int(ends[state]), depth + int(ends[kinds + state])
            yield batch.assign(state=states, depth=depths).drop(columns="map")

    def read(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for file, low, high, state, depth in batch[["path", "low", "high", "state", "depth"]].itertuples(
                    index=False, name=None):
                no = 0
                for raw in automaton.records(file, low, high, state, depth):
                    if not low and not no:
                        raw = raw.removeprefix(b"\xef\xbb\xbf")
                    text = raw.decode(encoding, "replace").strip("\r\n")
                    if text.strip(automaton.blank):
                        held.append((file, low, text, no))
                        no += 1
                        size += len(raw)
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield pd.DataFrame(held, columns=columns)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    spans, found = "path string, low long, high long", "path string, low long, value string, no long"
    if kinds == 1:                                  # every range begins in the one state there is
        return each_alone(cut.withColumns({"state": F.lit(0), "depth": F.lit(0)}), "path",
                          "low").mapInPandas(read, found)
    maps = each_alone(cut, "path", "low").mapInPandas(summarize, f"{spans}, map array<int>")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    states = materialize(maps.repartition(tasks, "path").sortWithinPartitions("path", "low").mapInPandas(
        begin, f"{spans}, state int, depth int"), "states")
    return each_alone(states, "path", "low").mapInPandas(read, found)
