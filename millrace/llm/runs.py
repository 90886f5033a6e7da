"""Periodic runs of words, by minimizers at several scales.

A run is a stretch of consecutive words of smallest period q (words q apart are equal), at least
``max(LEAST, POWER * q)`` words long, that no neighbouring word extends. All runs are found:

* Periods up to ``SHORT`` by a direct scan at each lag.
* Longer ones scale by scale, periods q with w < q <= 2w for w = SHORT, 2 SHORT, 4 SHORT, ... Every
  stretch of k = 2w words has a hash, and of each window of w neighbouring stretches the least hash
  (the leftmost of equal ones) marks its place. Inside a run a window and the one q words on hold
  the same hashes, so they mark places q apart; as 4q >= w + k + q, both windows fit in the run. And
  k >= q, so equal stretches less than q apart would give the run a smaller period (Fine and Wilf).
  Hence the mark before, of those with the same hash, is exactly q away, and it is enough to look
  at neighbouring marks of one hash. Each such pair at a distance of the scale is a seed.
* A seed is extended by comparing the words themselves, to both sides as far as they stay equal, in
  steps of growing size. Seeds inside a stretch that is already known at their lag are passed over.

A stretch found at several lags has the smallest as its period; the others are multiples.
The hashes only choose seeds: two different stretches of one 64-bit hash could hide a run, nothing
that is reported depends on them. Marks are about 2 / w of all places, so every scale costs a few
passes over the texts that are long enough for it and memory stays in proportion to a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .words import blocks, numbered, split_words, text_of

LEAST = 6                   # words of the shortest run
POWER = 4                   # periods that a run holds at least
SHORT = 16                  # the longest period that is scanned for directly
RUN = np.dtype([("text", np.int64), ("start", np.int64), ("length", np.int64), ("period", np.int64)])
SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, "
          "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _least_length(period: int) -> int:
    return max(LEAST, POWER * period)


def _lag_runs(words: np.ndarray, text: np.ndarray, lag: int) -> np.ndarray:
    """``start, length`` of all maximal stretches with this lag that are long enough."""
    same = np.zeros(len(words) + 2 - min(lag, len(words)), np.int8)
    if lag < len(words):
        same[1:-1] = (words[:-lag] == words[lag:]) & (text[:-lag] == text[lag:])
    turns = np.flatnonzero(np.diff(same))
    starts, length = turns[::2], turns[1::2] - turns[::2] + lag
    fits = length >= _least_length(lag)
    return np.stack([starts[fits], length[fits]], 1)


def _marks(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that are the leftmost least of some window of that many (a power of two) hashes."""
    least = np.arange(len(hashes))
    step = 1
    while step < window:
        if len(least) <= step:
            break
        one, two = least[:-step], least[step:]
        least = np.where(hashes[two] < hashes[one], two, one)
        step *= 2
    return np.unique(least)


def _same_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of both are equal, comparing a growing number at a time."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        to = min(n, at + step)
        differs = a[at:to] != b[at:to]
        if differs.any():
            return at + int(differs.argmax())
        at, step = to, step * 2
    return n


def _extended(words: np.ndarray, low: int, high: int, at: int, lag: int) -> tuple[int, int]:
    """The stretch with this lag around ``at`` inside ``low..high``."""
    ahead = _same_ahead(words[at:high - lag], words[at + lag:high])
    back = _same_ahead(words[low:at][::-1], words[low + lag:at + lag][::-1])
    return at - back, at + ahead + lag


def _scale_runs(words, hashes, place, bounds, text, window) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs of one scale; ``place`` are the hashes' places."""
    marks = _marks(hashes, window)
    marks = marks[hashes[marks] != _NONE]
    order = marks[np.lexsort((marks, hashes[marks]))]
    one, two = place[order[:-1]], place[order[1:]]
    lag = two - one
    seeds = ((hashes[order[:-1]] == hashes[order[1:]]) & (text[one] == text[two])
             & (lag > window) & (lag <= 2 * window))
    one, lag = one[seeds], lag[seeds]
    by = np.lexsort((one, lag))
    out, known = [], (0, -1)
    for at, q in zip(one[by].tolist(), lag[by].tolist()):
        if known[0] == q and at < known[1]:
            continue
        t = text[at]
        start, end = _extended(words, int(bounds[t]), int(bounds[t + 1]), at, q)
        known = (q, end - q)
        if end - start >= _least_length(q):
            out.append((start, end - start, q))
    return out


def runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs (``RUN``) of texts whose words' numbers stand between neighbouring ``bounds``.

    They are in order of text, start and period; ``start`` counts from the text's first word.
    """
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    found = [np.zeros((0, 3), np.int64)]
    for lag in range(1, SHORT + 1):
        stretches = _lag_runs(words, text, lag)
        found.append(np.column_stack([stretches, np.full(len(stretches), lag)]))
    window, size = SHORT, 1
    place, hashes = np.arange(len(words)), _mixed(words.astype(np.uint64) + np.uint64(1))
    while True:
        # Texts that can hold a run of this scale; the others' places go.
        fits = sizes >= _least_length(window + 1)
        if not fits.any():
            break
        stay = fits[text[place]]
        place, hashes = place[stay], hashes[stay]
        while size < 2 * window:
            after = np.append(hashes[size:], np.full(min(size, len(hashes)), _NONE))[:len(hashes)]
            hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + after)
            size *= 2
        whole = place + size <= bounds[text[place] + 1]
        seen = np.where(whole, np.minimum(hashes, _NONE - np.uint64(1)), _NONE)
        found.append(np.array(_scale_runs(words, seen, place, bounds, text, window),
                              np.int64).reshape(-1, 3))
        window *= 2
    every = np.concatenate(found)
    # A stretch that is found at several lags has the smallest one as its period.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[new]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    out = np.zeros(len(every), RUN)
    out["text"] = text[every[:, 0]]
    out["start"] = every[:, 0] - bounds[out["text"]]
    out["length"], out["period"] = every[:, 1], every[:, 2]
    return out


def dropped(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words stand in a run after that run's first period."""
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    at = bounds[found["text"]] + found["start"]
    np.add.at(change, at + found["period"], 1)
    np.add.at(change, at + found["length"], -1)
    return np.cumsum(change[:-1]) > 0


def _found(texts: pa.Array):
    """The words, their bounds, the runs and the words that go, of one block of texts."""
    words, bounds = split_words(texts)
    numbers, _ = numbered(words)
    found = runs(numbers, bounds)
    return words, bounds, found, dropped(found, bounds)


def _collapsed(words: pa.Array, bounds: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    if gone.any():
        words = words.filter(pa.array(~gone))
        bounds = np.append(0, np.cumsum(~gone))[bounds]
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words)
    return pc.binary_join(lists, pa.scalar(" ", words.type))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _longest(found: np.ndarray, n: int) -> dict[str, pa.Array]:
    """Each text's run of greatest length, by ties the one that starts first; null without runs."""
    order = np.lexsort((found["period"], found["start"], -found["length"], found["text"]))
    best = found[order]
    first = np.ones(len(best), bool)
    first[1:] = best["text"][1:] != best["text"][:-1]
    best = best[first]
    empty = np.ones(n, bool)
    empty[best["text"]] = False
    out = {}
    for name, values in (("start", best["start"]), ("length", best["length"]),
                         ("period", best["period"]),
                         ("exponent_milli", 1000 * best["length"] // np.maximum(best["period"], 1))):
        column = np.zeros(n, np.int64)
        column[best["text"]] = values
        out[name] = pa.array(column, mask=empty)
    return out


def _reported(texts: pa.Array) -> dict[str, pa.Array]:
    words, bounds, found, gone = _found(texts)
    n = len(texts)
    counts = np.bincount(found["text"], minlength=n)
    ends = np.append(0, np.cumsum(counts))
    lines = [f"{s},{k},{q}\n" for s, k, q in
             zip(found["start"].tolist(), found["length"].tolist(), found["period"].tolist())]
    nothing = _sha("")
    shas = [nothing if a == b else _sha("".join(lines[a:b])) for a, b in zip(ends, ends[1:])]
    kept = [_sha(t) for t in _collapsed(words, bounds, gone).to_pylist()]
    return {"n_words": pa.array(np.diff(bounds)), "n_runs": pa.array(counts), **_longest(found, n),
            "runs_sha256": pa.array(shas, pa.string()),
            "collapsed_sha256": pa.array(kept, pa.string())}


def report(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: how many runs, the longest, and digests.

    ``runs_sha256`` is of every run's ``start,length,period`` and a line break, by start and
    period; ``collapsed_sha256`` of the words left when each run keeps its first period, joined by
    one space. Null, empty and blank texts have no words and no runs. Rows are worked on alone, so
    repeated rows and ids give repeated results, and a null ``doc_id`` stays null. Other columns
    than ``doc_id`` and ``text`` are ignored.
    """
    def run(batches):
        for batch in batches:
            at = 0
            for _, part in blocks(text_of(batch)):
                columns = _reported(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), *columns.values()],
                    names=["doc_id", *columns])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def all_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, period`` of every run."""
    def run(batches):
        for batch in batches:
            at = 0
            for _, part in blocks(text_of(batch)):
                found = _found(part)[2]
                ids = batch.column("doc_id").slice(at, len(part)).take(pa.array(found["text"]))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(found[c]) for c in ("start", "length", "period"))],
                    names=["doc_id", "start", "length", "period"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with every run cut to its first period, all columns kept.

    Texts without runs stay as they are; of the others the kept words are joined by one space.
    ``n_chars``, if there is such a column, is left alone.
    """
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, out = text_of(batch), []
            for _, part in blocks(texts):
                words, bounds, found, gone = _found(part)
                hit = np.zeros(len(part), bool)
                hit[found["text"]] = True
                out.append(pc.if_else(pa.array(hit), _collapsed(words, bounds, gone), part))
            at = batch.schema.get_field_index("text")
            new = pa.chunked_array(out).combine_chunks()
            new = pc.if_else(pc.is_null(batch.column("text")), pa.scalar(None, new.type), new)
            yield batch.set_column(at, batch.schema.field(at), new.cast(batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with runs planted in a tenth of the texts, as a test bed.

    With h the CRC-32 of the decimal ``doc_id`` and g = h / 10, rounded down: if h is a multiple of
    10, each of the n words from a = g % n on becomes word a + (i - a) % p, where p is
    1 + (n - a) / (3 + g % 8), rounded down. Other texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(s):
        n, g = F.size(s["w"]).cast("long"), s["g"]
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        bound = F.array(F.struct(s["w"].alias("w"), a.alias("a"), p.alias("p")))
        return F.array_join(F.element_at(F.transform(bound, lambda b: F.transform(
            b["w"], lambda w, i: F.when(i < b["a"], w).otherwise(
                F.get(b["w"], (b["a"] + (i - b["a"]) % b["p"]).cast("int"))))), 1), " ")

    # Bound by lambdas, so that a text is split once and not for every word.
    bound = F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g")))
    text = F.when(h % 10 == 0, F.element_at(F.transform(bound, planted), 1)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))
