"""Packing of token sequences by best-fit decreasing, exact over the whole corpus.

Every text is tokenised and cut into full windows and a rest. All lengths lie between 1 and the
window size, so what best-fit decreasing does follows from how many pieces there are of each
length: at most 4096 counts, whatever the size of the data. The driver packs these counts with a
segment tree indexed by remaining capacity, which finds the tightest window that is open; equal
pieces and equal windows are taken together. The result is a list of runs (the pieces of one
length ranked a to b go to the windows s onwards at offset o), whose number is bounded by the
window size and not by the data. A piece's rank among those of its length comes from its place
in its task and the counts of the tasks before.

Words are tokenised once for each block of texts: the tokeniser never joins across white space,
nor across a letter and a following mark of ``MARKS``, so a text's ids are those of its words.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.session import materialize

from .words import blocks, lean, numbered, split_words, sums, text_of

CAPACITY = 4096
END = 2
BLOCK = 8 << 20
CACHED = 400_000                    # words in each of the two generations a task keeps
# Fixed: ASCII marks that end a run of letters and never compose with what stands before.
MARKS = r"[.,;:!?*#$%&]"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, "
          "nth long")


class Tokens:
    """Ids of texts, word by word, with the ids of words seen before kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        normal = self.model.normalizer
        self.lowers = normal is not None and all(
            normal.normalize_str(chr(c)) == chr(c + 32) for c in range(65, 91))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids; a word that is met again stays, others go with their generation.

        Words of ASCII alone are kept in lower case where the tokeniser's own normaliser lowers
        them: marks that could compose with a capital are not ASCII.
        """
        if self.lowers:
            words = [w.lower() if w.isascii() else w for w in words]
        found = list(map(self.young.get, words))
        open_ = [i for i, ids in enumerate(found) if ids is None]
        fresh = dict.fromkeys(words[i] for i in open_)
        missing = []
        for w in fresh:
            ids = self.old.get(w)
            if ids is None:
                missing.append(w)
            else:
                fresh[w] = ids
        encoded = self.model.encode_batch_fast(missing, add_special_tokens=False)
        for w, e in zip(missing, encoded):
            fresh[w] = array("I", e.ids).tobytes()
        self.young.update(fresh)
        for i in open_:
            found[i] = fresh[words[i]]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by ``END``; each text's bounds in them."""
        apart = pc.replace_substring_regex(texts, f"([A-Za-z])({MARKS})", r"\1 \2")
        words, bounds = split_words(apart)
        numbers, different = numbered(words)
        ids = self._ids(different.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first = np.cumsum(sizes) - sizes
        each = sizes[numbers]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(first[numbers] - (ends - each), each) + np.arange(total)
        per_text = sums(each, bounds)
        at = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(at[-1], END, np.uint32)
        hold = np.ones(at[-1], bool)
        hold[at[1:] - 1] = False
        out[hold] = flat[source]
        return out, at


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together until they hold so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Tightest:
    """A segment tree over remaining capacities: the least one, from a bound on, that is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, at: int, is_open: bool) -> None:
        node = at + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def find(self, least: int) -> int | None:
        node = least + self.size
        while not self.open[node]:
            while node & 1:                     # a right child: go up to a node with more right
                node //= 2
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:          # ran over the right edge of its level
                return None
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Runs ``(length, first rank, pieces, first sequence, offset)`` that pack all pieces.

    Longest first, each into the open window with the least room that suffices, else into a new
    one, which is what packing piece by piece does. Pieces of one length are interchangeable.
    """
    tree = Tightest(capacity)
    room: dict[int, list[tuple[int, int]]] = {}     # remaining capacity: (first window, windows)
    runs, windows = [], 0

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            room.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        need, rank = counts[length], 0
        while need:
            left = tree.find(length)
            if left is None:
                left, first, there = capacity, windows, -(-need // (capacity // length))
                windows += there
            else:
                first, there = room[left].pop()
                if not room[left]:
                    tree.set(left, False)
            each = left // length
            full = min(there, need // each)
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - left + k * length))
                rank += full
            need -= full * each
            give(left - each * length, first, full)
            rest = there - full
            if rest and need < each:                # the last window takes what there is
                for k in range(need):
                    runs.append((length, rank, 1, first + full, capacity - left + k * length))
                    rank += 1
                if need:
                    give(left - need * length, first + full, 1)
                    full, rest, need = full + 1, rest - 1, 0
                give(left, first + full, rest)
    return runs


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row: full windows and a rest, with checksums of their ids."""
    @lean
    def run(batches):
        tokens, task, seen = Tokens(path), TaskContext.get().partitionId(), {}
        for batch in gathered(batches, BLOCK):
            doc_ids = batch.column("doc_id").to_pylist()
            for first, part in blocks(text_of(batch), BLOCK):
                ids, at = tokens.encode(part)
                rows = []
                for k in range(len(part)):
                    a, total = at[k], int(at[k + 1] - at[k])
                    for start in range(0, total, capacity):
                        size = min(capacity, total - start)
                        nth = seen[size] = seen.get(size, -1) + 1
                        crc = zlib.crc32(ids[a + start:a + start + size].astype("<u4").tobytes())
                        rows.append((doc_ids[first + k], start, size, crc, total, task, nth))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each text goes: ``sequence_id`` and ``offset``.

    A null or blank text is the end id alone. Repeated rows and rows without id are packed like
    all others. Sequences are numbered from 0; within one, offsets have no gaps. Only ``doc_id``
    and ``text`` are used.
    """
    cut = materialize(pieces(docs, path, capacity), "pieces")
    tasks = cut.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0))
                         .alias("base"))
    # At most as many rows as the window has tokens.
    counts = {r["length"]: r["n"] for r in
              tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_decreasing(counts, capacity)), np.int64).reshape(-1, 5)
    key = runs[:, 0] << 44 | runs[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False)
                            for c in ("length", "rank"))
            run = np.searchsorted(key, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(runs[run, 3] + rank - runs[run, 1]),
                 pa.array(runs[run, 4])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(bases, ["task", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, "
                                    "doc_tokens long, sequence_id long, offset long")
