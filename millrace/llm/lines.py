"""Line deduplication by a deletion-neighbourhood join: equal lines, and lines few edits apart.

A line is compared without white space at its ends; lines under ``least`` code points are left
alone. Of equal lines the earliest stays (by ``doc_id``, then place). A line also goes if an
earlier line can be made from it by inserting, deleting or replacing few code points, whether or
not that earlier line stays itself. How many are few follows from the shorter line of the two:
one for each ``PER_EDIT`` code points, at most ``edits`` (up to 3), and none under ``MIN_CHARS``.

Of two lines at most three edits apart, either the beginning or the end of half the length has at
most one edit. Such a half is cut into two pieces:

* One piece has no edit; if it is the inner one, it may stand one place off. Its hash is a *spot*,
  eight for each line. Only lines that share a spot with another line go on, by that spot. In a
  spot shared by few, lines are paired at once; also in all others, if the pairs are not many, but
  there each line takes its text along and looks for one near line, so that no pairs are written.
* The other piece has at most one edit, so the two have a variant in common that lacks at most one
  code point. All these variants are hashed together with the spot: the *keys* that lines are
  joined by. A key whose lines all agree in the piece is left to the key of the whole piece.

A pair is dropped where the lengths or the letters differ by more than the edits allow: of a line
the counts of ``CLASSES`` classes of letters are kept, each modulo 32, which is exact for lines that
are near (``_alike``). Every line is split, hashed and cut once and written as such; texts are only
fetched for what is left.

Lines of a key shared by few are all compared; each drop is confirmed by the edit distance. In a
key shared by many each line is compared with the earliest one. Where lines are left that are not
near it, the lines of the key are cut again: what lies outside the half is at most three edits
apart too (a shifted border included), so the same step holds for it, within the key. What is too
short to be cut is joined by all its variants that lack up to three code points. So a family of
lines that differ in a number is split by the number's own pieces, and not compared pair by pair.

Lengths differ by up to three, so pieces are measured by the steps of a grid that the lengths of
both lines touch (``_grid``); a line has the pieces of one or two such steps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import materialize

from .pii import renewed
from .words import bytes_of, lean

MIN_CHARS = 20
PER_EDIT = 10
MOST = 3                        # edits that the halves are made for
FEW = 16                        # lines of one spot or key that are all compared
DIRECT = 4                      # pairs for each line that are written rather than cut further
WIDE = 64                       # pairs for each line that are compared within spots
DEAL = 256                      # lines of a spot that one task holds against all of it
CLASSES = 12                    # of letters, 5 bits each
SHORT = 8                       # steps up to which a part is not cut any more
ID_BITS = 40                    # of a line's id by which the lines of a spot are told apart
ENDS = " \t\v\f\r"
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def bound(chars: Column, edits: int) -> Column:
    """The edits allowed between two lines of which the shorter has ``chars`` code points."""
    return F.when(chars < MIN_CHARS, 0).otherwise(
        F.least(F.lit(edits), F.floor(chars / PER_EDIT).cast("int")))


def _key(line: Column) -> list[Column]:
    """128 bits of hash."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(2), line).alias("b")]


def _places(docs: DataFrame) -> DataFrame:
    """``missing, id`` of every row (ids that are null are one document) and its text."""
    return docs.select(F.col("doc_id").isNull().alias("missing"),
                       F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
                       F.coalesce("text", F.lit("")).alias("text"))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """``missing, doc, no`` (its place), ``line, a, b`` (128 bits of hash) of each compared line."""
    split = _places(docs).select("missing", "id", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    line = split.select("missing", F.col("id").alias("doc"), "no",
                        F.trim("raw", F.lit(ENDS)).alias("line")).where(F.length("line") >= least)
    return line.select("*", *_key(F.col("line")))


def _grid(n: Column) -> Column:
    """The step at or below a length. Steps are more than ``MOST`` apart."""
    return F.when(n < 32, F.floor(F.greatest(n, F.lit(0)) / 4) * 4).otherwise(
        F.floor(n / 32) * 32).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _grids(n: np.ndarray) -> np.ndarray:
    return np.where(n < 32, np.maximum(n, 0) // 4 * 4, n // 32 * 32)


@cache
def _letters() -> np.ndarray:
    """A hash of every code point."""
    return _mixed(np.arange(1, 0x110001, dtype=np.uint64))


@cache
def _classes() -> np.ndarray:
    """One in the bits of the class of every code point."""
    return np.uint64(1) << (np.arange(0x110000, dtype=np.uint64) % np.uint64(CLASSES) * np.uint64(5))


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``2 ** bits`` powers of the base and of its inverse."""
    out = []
    for base in (_BASE, _BACK):
        power = np.full(1 << bits, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return tuple(out)


def _codes(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all parts, and how many each one has."""
    parts = parts.cast(pa.large_string())
    body, _ = bytes_of(parts)
    sizes = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(body) != sizes.sum():
        body = np.frombuffer(body.tobytes().decode().encode("utf-32-le", "surrogatepass"), "<u4")
    return body, sizes


def _bags(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many code points of each class every part has, side by side; counts run over into the
    next class, so that only the difference of two bags that are alike means something."""
    total = np.append(np.uint64(0), np.cumsum(_classes()[codes], dtype=np.uint64))
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) & np.uint64((1 << 5 * CLASSES) - 1)


def _alike(one: str, two: str, edits: int) -> Column:
    """Whether two bags may belong to lines so many edits apart: an edit changes two counts by one."""
    middle = sum(16 << 5 * k for k in range(CLASSES))
    apart = F.col(one) - F.col(two) + F.lit(middle)
    return reduce(lambda x, y: x + y, [F.abs(F.shiftright(apart, 5 * k).bitwiseAND(F.lit(31)) - 16)
                                       for k in range(CLASSES)]) <= 2 * edits


def _hash_pieces(codes: np.ndarray, sizes: np.ndarray, paths: np.ndarray,
                 step: np.ndarray) -> dict[str, np.ndarray]:
    """``row, spot, code`` of the pieces of each part, by hashes of its beginnings."""
    starts = np.cumsum(sizes) - sizes
    powers, down = _powers(max(20, len(codes).bit_length()))
    before = np.append(np.uint64(0), np.cumsum(_letters()[codes] * powers[:len(codes)], dtype=np.uint64))
    first = np.where(step >= 0, step, _grids(sizes))
    second = np.where(step >= 0, step, _grids(sizes - MOST))
    other = np.flatnonzero(second != first)
    out = {"row": [], "spot": [], "code": []}

    def emit(row, seed, found, code):
        out["row"].append(row)
        out["spot"].append(_mixed(found ^ _mixed(paths[row] + seed.astype(np.uint64))))
        out["code"].append(code.astype(np.int32))

    for row, own in ((np.arange(len(sizes)), first), (other, second[other])):
        cut = own > SHORT
        left = row[~cut]
        emit(left, own[~cut], np.zeros(len(left), np.uint64), np.zeros(len(left)))
        row, own = row[cut], own[cut]
        q, low, high = own // 4, starts[row], starts[row] + sizes[row]
        for side in (0, 1):
            for which in (0, 1, 2, 3):
                at = np.zeros_like(q) if which == 0 else q + which - 2
                at = high - at - q if side else low + at
                emit(row, 8 * own + 2 * side + (which > 0) + 1,
                     (before[at + q] - before[at]) * down[at], 8 * own + 4 * side + which)
    return {c: np.concatenate(v) for c, v in out.items()}


def _sketches(docs: DataFrame, least: int) -> DataFrame:
    """``missing, doc, no, a, b, size, bag, spots`` of each compared line; lines under ``MIN_CHARS``
    have no spots, which are pairs of ``spot`` and ``code`` (see ``_spots``)."""
    names = ("missing", "doc", "no", "a", "b")
    kind = pa.list_(pa.struct([("spot", pa.int64()), ("code", pa.int32())]))

    @lean
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, sizes = _codes(batch.column("line"))
            long = np.flatnonzero(sizes >= MIN_CHARS)
            kept = codes if len(long) == len(sizes) else codes[np.repeat(sizes >= MIN_CHARS, sizes)]
            found = _hash_pieces(kept, sizes[long], np.zeros(len(long), np.uint64),
                                 np.full(len(long), -1))
            row = long[found["row"]]
            order = np.argsort(row, kind="stable")
            spots = pa.StructArray.from_arrays(
                [pa.array(found["spot"][order].view(np.int64)), pa.array(found["code"][order])],
                ["spot", "code"])
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sizes.astype(np.int32)),
                 pa.array(_bags(codes, sizes).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), spots).cast(kind)],
                names=[*names, "size", "bag", "spots"])

    return _lines(docs, least).select(*names, "line").mapInArrow(
        run, "missing boolean, doc long, no int, a long, b long, size int, bag long, "
             "spots array<struct<spot:long,code:int>>")


def _spots(rows: DataFrame) -> DataFrame:
    """``spot, id, path, code`` of ``rows`` (``id, path, part, step``).

    Spots are hashes of the pieces without edit. A ``step`` under 0 stands for those of the part's
    own length. ``code`` is 8 * step + 4 if from the end + 0 for the outer piece, or 1, 2, 3 for the
    inner one standing a place early, in place, a place late; two lines share a spot only if one of
    them has it in place. Parts that are not cut share a spot with all others of their path and
    step; its code is 0.
    """
    @lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                path = batch.column("path").to_numpy()
                found = _hash_pieces(*_codes(batch.column("part")), path.view(np.uint64),
                                     batch.column("step").to_numpy().astype(np.int64))
                row = found["row"]
                yield pa.RecordBatch.from_pydict({
                    "spot": found["spot"].view(np.int64), "id": batch.column("id").to_numpy()[row],
                    "path": path[row], "code": found["code"]})

    return rows.select("id", "path", "part", "step").mapInArrow(
        run, "spot long, id long, path long, code int")


def _shared(spots: DataFrame) -> DataFrame:
    """The ``spots`` that different lines share, as ``spot, id, path, code, n``: shared by ``n``."""
    some = F.col("id").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    whole = (F.col("code") % 4).isin(0, 2)
    shared = spots.groupBy("spot").agg(F.min(some).alias("low"), F.max(some).alias("high"),
                                       F.bool_or(whole).alias("whole"))
    shared = shared.where("low < high and whole").select("spot")
    rows = materialize(spots.join(shared.hint("shuffle_hash"), "spot", "left_semi").distinct(), "shared")
    lines = rows.groupBy("spot").agg(F.count("*").alias("n"))
    return rows.join(lines.hint("merge"), "spot")


def deletions(text: str) -> tuple[int, np.ndarray]:
    """A hash of the text, and the different hashes of it with one code point left out."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    terms = _mixed(codes + np.uint64(1)) * powers
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    without = before[:-1] + (before[-1] - before[1:]) * _BACK
    return int(before[-1]), np.unique(without)


def _all_deletions(text: str) -> np.ndarray:
    """Hashes of the text with up to ``MOST`` code points left out."""
    n = len(text)
    return np.unique([deletions("".join(text[i] for i in range(n) if i not in gone))[0]
                      for k in range(min(MOST, n) + 1) for gone in map(set, combinations(range(n), k))])


def _piece(part: str, code: int) -> str:
    """The piece beside the spot of that code, which may have an edit."""
    step, side, which = code >> 3, code >> 2 & 1, code & 3
    text, q = part[::-1] if side else part, step // 4
    return text[q:2 * q] if which == 0 else text[:q + which - 2]


def _keys_of(part: str, code: int, varied: bool) -> tuple[np.ndarray, int, bool]:
    """Hashes of the variants of a part beside its spot, a hash of the piece that they are of, and
    whether the first one is the key of the whole piece, for lines that agree in it.

    Where all lines of the spot agree in the piece (not ``varied``) there is that key only.
    """
    if code == 0:
        return _all_deletions(part).astype(np.uint64), deletions(part)[0], False
    piece, which = _piece(part, code), code & 3
    whole, keys = deletions(piece)
    if not varied:
        keys = keys[:0]
    # Lengths keep variants of pieces of different length apart; of the inner spot a whole piece
    # meets the variants of a piece that is one longer.
    keys = _mixed(keys + np.uint64(len(piece) - 1 if piece else 0))
    own = _mixed(np.array([whole], np.uint64) + np.uint64(len(piece)))
    if which == 0:
        return np.append(own ^ np.uint64(1), keys), whole, True
    return {1: own, 2: np.append(own, keys), 3: keys}[which][:None if varied else 0], whole, False


def _variants(rows: DataFrame) -> DataFrame:
    """``group, id, path, code, piece, same`` of ``rows`` (``id, path, part, code, spot,
    varied``).

    ``group`` is a hash of the spot and of a variant of the piece beside it; ``same`` marks the
    key of the whole piece.
    """
    @lean
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("group", "id", "path", "code", "piece", "same")}
            for i, path, part, code, spot, varied in zip(*(batch.column(c).to_pylist() for c in (
                    "id", "path", "part", "code", "spot", "varied"))):
                keys, whole, same = _keys_of(part, code, varied)
                groups = _mixed(keys ^ np.uint64(spot & 0xFFFFFFFFFFFFFFFF))
                n = len(groups)
                out["group"].append(groups.view(np.int64))
                out["piece"].append(np.full(n, whole, np.uint64).view(np.int64))
                for c, v in (("id", i), ("path", path), ("code", code)):
                    out[c].append(np.full(n, v, np.int32 if c == "code" else np.int64))
                out["same"].append(same & (np.arange(n) == 0))
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in out.items()})

    return rows.select("id", "path", "part", "code", "spot", "varied").mapInArrow(
        run, "group long, id long, path long, code int, piece long, same boolean")


def _beside() -> Column:
    """A hash of the piece beside the spot (see ``_piece``)."""
    q = F.floor(F.col("code") / 32).cast("int")
    which, from_end = F.col("code") % 4, F.floor(F.col("code") / 4) % 2 == 1
    size = F.when(which == 0, q).otherwise(q + which - 2)
    at = F.when(which == 0, q).otherwise(0)
    start = F.when(from_end, F.length("part") - at - size).otherwise(at)
    return F.xxhash64(F.substring("part", start + 1, size))


def _groups(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """``group, n, id, path, code, same``: the keys that different lines share."""
    own = materialize(shared, "spots").drop("n").join(rows.hint("merge"), ["id", "path"])
    own = own.withColumn("beside", F.when(F.col("code") > 0, _beside()))
    varied = own.groupBy("spot").agg((F.min("beside") < F.max("beside")).alias("varied"))
    own = own.drop("beside").join(varied.hint("merge"), "spot").withColumn(
        "varied", F.coalesce("varied", F.lit(True)))
    keys = materialize(_variants(own), "keys")
    # Of the key of a whole piece and of what is not cut the lines differ, of others the pieces.
    differs = F.when(F.col("same") | (F.col("code") == 0), F.col("id")).otherwise(F.col("piece"))
    met = keys.groupBy("group").agg(F.count("*").alias("n"), F.min(differs).alias("low"),
                                    F.max(differs).alias("high")).where("low < high")
    return keys.select("group", "id", "path", "code", "same").join(
        met.select("group", "n").hint("merge"), "group").distinct()


def _near(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``id`` of the lines in ``pairs`` (``id, other``) that are near the other line."""
    one = texts.select("id", "line")
    two = texts.select(F.col("id").alias("other"), F.col("line").alias("before"))
    both = pairs.distinct().join(one.hint("merge"), "id").join(two.hint("merge"), "other")
    most = bound(F.least(F.length("line"), F.length("before")), edits)
    distance = F.levenshtein("line", "before", edits)
    return both.where((distance >= 0) & (distance <= most)).select("id").distinct()


def _may_be_near(edits: int) -> Column:
    """Whether ``first, size, bag`` are those of a line that may be near an earlier one's ``before,
    length, letters``."""
    return ((F.col("before") < F.col("first")) & (F.abs(F.col("size") - F.col("length")) <= edits)
            & _alike("bag", "letters", edits))


def _earlier(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(*columns, F.col("first").alias("before"), F.col("size").alias("length"),
                       F.col("bag").alias("letters"))


def _met(rows: DataFrame, others: DataFrame, edits: int, by: list[str]) -> DataFrame:
    """Pairs ``id, other`` of lines of one group that may be near, the other one the earlier."""
    other = _earlier(others, *by, F.col("id").alias("other"))
    return rows.join(other, by).where(_may_be_near(edits)).select("id", "other")


def _in_spots(shared: DataFrame, about: DataFrame) -> DataFrame:
    return shared.select("spot", "id", "n").distinct().join(about.hint("merge"), "id")


def _near_in_spots(rows: DataFrame, found: DataFrame, edits: int) -> DataFrame:
    """``id`` of the lines of ``rows`` (``spot, id, n, first, size, bag, line``), ``found`` ones
    aside, that are near an earlier line of their spot.

    Each line looks for such a line until there is one; pairs are not written. Large spots are
    dealt out.
    """
    parts = F.ceil(F.col("n") / DEAL).cast("int")
    one = rows.join(found.hint("merge"), "id", "left_anti").select(
        "spot", F.pmod(F.hash("id"), parts).alias("part"), "id", "first", "size", "bag", "line")
    two = _earlier(rows, F.col("spot").alias("place"), F.explode(
        F.sequence(F.lit(0), parts - 1)).alias("share"), F.col("line").alias("text"))
    most = bound(F.least("size", "length"), edits)
    distance = F.levenshtein("line", "text", edits)
    return one.join(two.hint("merge"), (F.col("spot") == F.col("place")) & (
        F.col("part") == F.col("share")) & _may_be_near(edits) & (distance >= 0) & (distance <= most),
        "left_semi").select("id").distinct()


def _neighbours(shared: DataFrame, about: DataFrame, edits: int, lines: int,
                fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id`` of the lines near an earlier line.

    ``about`` holds ``id, first, size, bag`` of the lines of ``shared``; ``fetch`` takes ``id`` and
    gives ``id, line``. ``lines`` is how many lines are compared in all.
    """
    found = texts = None
    while True:
        shared = materialize(shared, "sized")
        few, many = shared.where(F.col("n") <= FEW), shared.where(F.col("n") > FEW)
        near = _in_spots(few, about)
        pairs = materialize(_met(near, near, edits, ["spot"]).distinct(), "pairs")
        if texts is None:
            texts = fetch(pairs.select("id").unionByName(pairs.select(F.col("other").alias("id")))
                          .unionByName(many.select("id")))
            rows = texts.select("id", F.lit(0).cast("long").alias("path"), F.col("line").alias("part"))
        found = _more(found, pairs, texts, edits)
        # A line of a spot of n lines is in n rows' pairs, half of them on its side.
        wide = many.agg(F.sum(F.col("n") - 1)).first()[0]
        if wide is None:
            return found
        if wide <= 2 * WIDE * lines:
            open_ = materialize(_in_spots(many, about).join(texts.hint("merge"), "id"), "open")
            return materialize(_near_in_spots(open_, found, edits).unionByName(found), "near")
        groups = materialize(_groups(many, rows).join(about.hint("merge"), "id"), "groups")
        few, many = groups.where(F.col("n") <= FEW), groups.where(F.col("n") > FEW)
        hub = many.groupBy("group").agg(F.min(F.struct("first", "id", "size", "bag")).alias("hub"))
        spokes = many.join(hub.hint("merge"), "group").where(F.col("id") != F.col("hub.id"))
        pairs = _met(few, few, edits, ["group"]).unionByName(spokes.where(
            (F.abs(F.col("size") - F.col("hub.size")) <= edits) & _alike("bag", "hub.bag", edits)).select(
            "id", F.col("hub.id").alias("other")))
        found = _more(found, pairs, texts, edits)
        # Keys with a line that is not settled, the first one aside. A key of the whole piece
        # goes with the keys of its variants, all of which its lines share.
        open_ = spokes.join(found.hint("merge"), "id", "left_anti").select("group").distinct()
        left = many.drop("size", "bag").join(open_.hint("merge"), "group", "left_semi")
        varied = left.where(~F.col("same")).select("id", "path", "code").distinct()
        left = materialize(left.where(~F.col("same")).unionByName(left.where("same").join(
            varied.hint("merge"), ["id", "path", "code"], "left_anti")), "left")
        # What is not cut any more, and what is cheap: lines still open are compared with all
        # earlier ones of the key.
        sizes = left.join(found.hint("merge").withColumn("near", F.lit(True)), "id", "left").groupBy(
            "group").agg(F.count("*").alias("n"), F.count_if(F.col("near").isNull()).alias("open"),
                         F.max("code").alias("code"))
        cost = sizes.agg(F.count("*").alias("groups"), F.sum(F.col("open") * F.col("n")).alias("pairs"),
                         F.count_if(F.col("code") == 0).alias("last")).first()
        if not cost["groups"]:
            return found
        direct = cost["pairs"] <= DIRECT * lines
        if direct or cost["last"]:
            last = left.where(F.lit(direct) | (F.col("code") == 0)).join(
                about.hint("merge").drop("first"), "id")
            found = _more(found, _met(last.join(found.hint("merge"), "id", "left_anti"), last, edits,
                                      ["group"]), texts, edits)
        if direct:
            return found
        parts = left.where("code > 0").join(rows.hint("merge"), ["id", "path"])
        step, from_end = F.floor(F.col("code") / 8), F.floor(F.col("code") / 4) % 2 == 1
        size, half = F.length("part"), (2 * F.floor(step / 4)).cast("int")
        rest = F.when(from_end, F.substring("part", F.lit(1), size - half)).otherwise(
            F.substring("part", half + 1, size))
        rows = materialize(parts.select("id", F.col("group").alias("path"), rest.alias("part")).distinct(),
                           "parts")
        # Lines of about one length need one step only.
        lengths = rows.groupBy("path").agg(F.min(F.length("part")).alias("least"),
                                           F.max(F.length("part")).alias("most"))
        alike = F.col("most") * 3 <= 4 * _grid(F.col("least"))
        stepped = rows.join(lengths.hint("merge"), "path").withColumn(
            "step", F.when(alike, _grid(F.col("least"))).otherwise(-1))
        shared = _shared(_spots(stepped))


def _more(found: DataFrame | None, pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``found`` and the lines of the pairs that are near the other line."""
    if found is None:
        return materialize(_near(pairs, texts, edits), "near")
    near = _near(pairs.join(found.hint("merge"), "id", "left_anti"), texts, edits)
    return materialize(near.unionByName(found), "near")


def repeated(docs: DataFrame, edits: int = 1, least: int = MIN_CHARS) -> DataFrame:
    """``missing, id, no, line, near`` of every line to drop; ``near`` if no earlier one is equal.

    ``no`` counts the text's ``\\n``-split lines from 0 and ``line`` is a hash of the line without
    its ends, so that a drop holds for the line and not for what stands in the same place of
    another row. Null and empty texts have no lines to drop. Rows with one id count as one document
    with the lines of all: equal lines in the same place of such rows stay together. Rows without
    id (``missing``) come after all others, as one document. Only ``doc_id`` and ``text`` are used.
    Lines are near up to ``edits`` edits (1 to 3), fewer in short lines, see ``bound``; lines under
    ``least`` code points are left alone.
    """
    if not 1 <= edits <= MOST:
        raise ValueError("edits is 1, 2 or 3")
    lines = materialize(_sketches(docs, least), "lines")
    place = F.struct("missing", F.col("doc").alias("id"), "no")
    firsts = materialize(lines.groupBy("a", "b").agg(
        F.min(place).alias("first"), F.count("*").alias("n"), F.min("size").alias("size"),
        F.min("bag").alias("bag")), "firsts")
    spots = lines.select(F.col("a").alias("id"), F.explode("spots").alias("s")).select(
        "s.spot", "id", F.lit(0).cast("long").alias("path"), "s.code")
    shared = materialize(_shared(spots), "shared")
    about = materialize(firsts.withColumnRenamed("a", "id").join(
        shared.select("id").distinct().hint("merge"), "id", "left_semi").drop("n"), "open")

    def fetch(ids: DataFrame) -> DataFrame:
        """``id, line``: one row for each document is looked up, so that texts are not multiplied.
        Both sides grow with the data, so the plan is the same at every size."""
        wanted = materialize(about.select("id", "b", "first").join(
            ids.distinct().hint("merge"), "id", "left_semi"), "wanted")
        places = wanted.groupBy("first.missing", F.col("first.id").alias("doc")).agg(
            F.collect_set("first.no").alias("nos"))
        holders = _places(docs).withColumnRenamed("id", "doc").join(
            places.hint("merge"), ["missing", "doc"])
        texts = holders.select("missing", "doc", "nos", F.posexplode(F.split("text", "\n"))
                               .alias("no", "raw")).where(F.array_contains("nos", F.col("no")))
        texts = texts.select(place.alias("first"), F.trim("raw", F.lit(ENDS)).alias("line"))
        texts = texts.select("first", "line", *_key(F.col("line"))).withColumnRenamed("a", "id").join(
            wanted.hint("merge"), ["id", "b", "first"], "left_semi")
        return materialize(texts.select("id", "line").distinct(), "texts")

    near = _neighbours(shared, about.drop("b"), edits, firsts.count(), fetch).select(
        F.col("id").alias("a"), F.lit(True).alias("near"))
    bad = firsts.drop("size", "bag").join(near.distinct().hint("merge"), "a", "left").where(
        "n > 1 or near")
    hit = (lines.select(place.alias("first"), "a", "b").join(
        bad.withColumnRenamed("first", "earliest").hint("merge"), ["a", "b"])
        .where("earliest < first or near"))
    return hit.select("first.missing", "first.id", "first.no", F.col("a").alias("line"),
                      (F.col("first") == F.col("earliest")).alias("near")).distinct()


def _hash(raw: Column) -> Column:
    return F.xxhash64(F.trim(raw, F.lit(ENDS)))


def _lost(rows: DataFrame, docs: DataFrame, edits: int, least: int) -> DataFrame:
    """``rows`` (with ``_missing``, ``_id`` and ``_hashes`` or ``_lines``) and ``_drops``, the ``no,
    near`` that go from each row's own lines."""
    gone = repeated(docs, edits, least).groupBy("missing", "id").agg(
        F.collect_list(F.struct("no", "line", "near")).alias("_gone"))
    out = rows.join(gone.hint("merge"), (F.col("_missing") == F.col("missing"))
                    & (F.col("_id") == F.col("id")), "left").drop("missing", "id")
    line = (lambda no: F.get("_hashes", no)) if "_hashes" in rows.columns else (
        lambda no: _hash(F.get("_lines", no)))
    own = F.filter("_gone", lambda g: line(g["no"]) == g["line"])
    return out.withColumn("_drops", F.coalesce(F.transform(own, lambda g: F.struct(
        g["no"].alias("no"), g["near"].alias("near"))), F.expr(
        "cast(array() as array<struct<no int, near boolean>>)"))).drop("_gone")


def report(docs: DataFrame, edits: int = 1, least: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, dropped`` of every row: how many lines go, and which.

    A near line that stands several times counts as near once and as exact after that.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("doc_id").isNull().alias("_missing"),
                       F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"),
                       F.transform(F.split(text, "\n"), _hash).alias("_hashes"),
                       (F.length(text) > 0).alias("_filled"))
    out = _lost(rows, docs, edits, least)
    size = F.when(F.col("_filled"), F.size("_hashes")).otherwise(0).cast("long")
    near = F.size(F.filter("_drops", lambda d: d["near"])).cast("long")
    return out.select("doc_id", size.alias("n_lines"),
                      (F.size("_drops").cast("long") - near).alias("n_exact"), near.alias("n_near"),
                      F.array_sort(F.transform("_drops", lambda d: d["no"])).alias("dropped"))


def without_repeats(docs: DataFrame, edits: int = 1, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` without its repeated lines, all columns kept; a document left blank goes.

    Texts that lose nothing stay as they are, blank ones included. ``n_chars``, if there is such
    a column, counts the new text.
    """
    doc_id, text = F.col("_row.doc_id"), F.col("_row.text")
    rows = docs.select(F.struct("*").alias("_row")).select(
        "_row", doc_id.isNull().alias("_missing"),
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("_id"),
        F.split(F.coalesce(text, F.lit("")), "\n").alias("_lines"))
    joined = _lost(rows, docs, edits, least).withColumn("_nos", F.transform("_drops", lambda d: d["no"]))
    changed = F.size("_nos") > 0
    kept = F.array_join(F.transform(F.filter(
        F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: ~F.array_contains("_nos", s["i"])), lambda s: s["x"]), "\n")
    out = joined.withColumn("_new", F.when(changed, kept).otherwise(text)).where(
        ~changed | (F.length(F.trim("_new", F.lit(ENDS + "\n"))) > 0))
    return renewed(out, docs, "text", changed)
