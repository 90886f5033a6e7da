"""Quality rules from repetition: a suffix array over the words of each whole text.

The suffixes of all texts of a block are sorted by prefix doubling; the rank of a suffix begins
with its text's number, so suffixes of different texts never share a prefix. Each doubling only
sorts anew the suffixes that are not told apart yet. The common prefix of neighbours in the
suffix array follows from the ranks of the doublings. The longest repeat that starts at a word
is the larger of the two common prefixes beside its suffix: the depth of the innermost
longest-common-prefix interval that holds it, and the maximal repeated substrings are such
stretches that do not lie inside the one before. Their spans are united by a running sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import blocks, bytes_of, lean, numbered, split_words, sums, text_of

MIN_WORDS = 50              # base: shorter texts fail
MIN_REPEAT = 8              # words of a repeat that counts for the two limits below
MOST_COVERED = 0.3          # share of words inside such repeats
MOST_LONGEST = 150          # words of the longest repeat
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, "
          "kept boolean")


def suffix_array(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each doubling the rank by the first 1, 2, 4, ... words.

    ``words`` are numbers of words, ``text`` the number of the text of each word.
    """
    n = len(words)
    order = np.lexsort((words, text))
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = heads + 1
    rank[n] = 0
    last = np.ones(n, bool)                       # of its text
    last[:-1] = text[1:] != text[:-1]
    ends = np.flatnonzero(last)
    end_of = ends[np.searchsorted(ends, np.arange(n))] + 1
    levels, step = [rank[:n].astype(np.int32)], 1
    while True:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)            # places in the order that are not settled
        if not len(slots):
            return order, levels
        open_ = order[slots]
        after = open_ + step
        follow = np.where(after < end_of[open_], rank[np.minimum(after, n)], 0)
        key = rank[open_] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        order[slots] = open_
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        new[slots] = first
        heads = np.maximum.accumulate(np.where(first, slots, 0))
        rank[open_] = heads + 1
        levels.append(rank[:n].astype(np.int32))
        step *= 2


def repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the length of the longest stretch from it that its text holds twice."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order, levels = suffix_array(words, text)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        i, j = a + common, b + common
        inside = (i < n) & (j < n)
        same = inside.copy()
        same[inside] = rank[i[inside]] == rank[j[inside]]
        common += same.astype(np.int64) << k
    beside = np.zeros(n + 1, np.int64)
    beside[1:n] = common
    longest = np.empty(n, np.int64)
    longest[order] = np.maximum(beside[:-1], beside[1:])
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words: the union of their spans."""
    n = len(longest)
    starts = np.flatnonzero(longest >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + longest[starts], -1)
    return np.cumsum(change[:-1]) > 0


def maximal_repeats(text: str, least: int = MIN_REPEAT) -> list[tuple[int, int]]:
    """First and end word of each maximal repeated stretch of one text."""
    numbers, _ = numbered(split_words(pa.array([text], pa.large_string()))[0])
    longest = repeats(numbers, np.zeros(len(numbers), np.int64))
    reach = np.arange(len(longest)) + longest
    inner = np.append([0], reach[:-1]) >= reach if len(longest) else np.zeros(0, bool)
    return [(int(s), int(reach[s])) for s in np.flatnonzero((longest >= least) & ~inner)]


def _measures(texts: pa.Array) -> dict[str, np.ndarray]:
    words, bounds = split_words(texts)
    numbers, _ = numbered(words)
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), counts)
    longest = repeats(numbers, text)
    raw, at = bytes_of(texts)
    symbol = np.isin(raw, np.frombuffer(SYMBOLS.encode(), np.uint8))
    space = np.isin(raw, np.frombuffer(SPACES.encode(), np.uint8))
    peak = np.zeros(len(texts), np.int64)
    np.maximum.at(peak, text, np.where(longest >= MIN_REPEAT, longest, 0))
    again = []
    for t in texts.to_pylist():
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        again.append(len(lines) - len(set(lines)))
    return {"n_words": counts, "word_chars": sums(~space & ((raw & 0xC0) != 0x80), at),
            "n_symbols": sums(symbol, at), "n_dup_lines": np.array(again, np.int64),
            "n_repeat_words": sums(covered(longest, 3), bounds),
            "n_covered_words": sums(covered(longest, MIN_REPEAT), bounds),
            "longest_repeat": peak}


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """All columns of ``SCHEMA`` but the id, for whole texts, block by block."""
    parts = [_measures(part) for _, part in blocks(texts)] or [_measures(texts)]
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = out["n_words"]
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n)
    out["kept"] = (~out["base_failed"] & (out["n_covered_words"] <= MOST_COVERED * n)
                   & (out["longest_repeat"] <= MOST_LONGEST))
    return out


def assess(docs: DataFrame) -> DataFrame:
    """Measures and verdict for every row of ``docs`` (``doc_id``, ``text``), repeats included.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. A null text has no words and so
    fails; a text without repeats has none covered. ``longest_repeat`` is 0 if shorter than
    ``MIN_REPEAT``. Only the two named columns are used.
    """
    @lean
    def run(batches):
        for batch in batches:
            m = measures(text_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, m.values())],
                                             names=["doc_id", *m])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    @lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(measures(text_of(batch))["kept"]))

    return docs.mapInArrow(run, docs.schema)
