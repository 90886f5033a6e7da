"""Near duplicates by circulant MinHash, banding and exact verification.

A text's set holds its different shingles of five words (lower-cased A-Z); a text of fewer words
has its whole sequence as its only shingle. Two permutations make all coordinates of a
signature: the first, an odd multiplication, places a shingle's hash on a circle of ``CIRCLE``
points; the second is a fixed random order of the circle, and coordinate k reads it k points
further on. So a shingle's 128 values are neighbours in memory. Bands of four coordinates are
hashed; texts that share a band are candidates and are confirmed on their full sets. At a
similarity of 0.75 a pair shares no band with a chance of 5 in a million.

Copies: texts with equal sets form a class, named by its smallest id; one row of each class is
compared. A band is not expanded into pairs. It has one hub, the member that shares most bands
with others, and every member is compared with hubs; confirmed links are joined to components.
What is left are pairs in a band whose members are in different components, so that one of them
at least is not linked to the hub. They are found without comparing all: a set is its hub's set
but for a few shingles, added or removed (its difference). Two sets x and y are linked if and
only if their differences d differ in at most (|x| + |y|) / 7 shingles, so differences share at
least (d_x + d_y - (|x| + |y|) / 7) / 2 of them, and by the prefix argument a shared one stands
among the first of both in any common order. The order is that of rarity among the differences to
the hub, and shingles of one component come before all others: what all rows around a hub share,
such as what none of them has of the hub, comes last and is hardly ever joined, and no link
between different texts is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.session import materialize

from .components import components
from .words import blocks, lean, numbered, split_words, text_of

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100     # least similarity
BANDS, ROWS = 32, 4
CIRCLE_BITS = 20
CIRCLE = 1 << CIRCLE_BITS
SEED = 20
CHUNK = 4096                         # shingles whose values are held at once


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, n, dtype=np.uint64) * 2 + 1


def shingle_sets(texts: pa.Array):
    """For each text its sorted different shingle hashes (``uint64``), in order of the texts."""
    factors = _factors(2 * SHINGLE)
    for _, part in blocks(texts):
        words, bounds = split_words(pc.ascii_lower(part))
        numbers, different = numbered(words)
        names = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in different),
                            np.uint64, len(different))
        hashed = names[numbers]
        windows = max(0, len(hashed) - SHINGLE + 1)
        whole = np.zeros(windows, np.uint64)
        for k in range(SHINGLE):
            whole += _mixed(hashed[k:k + windows] + factors[k]) * factors[k]
        whole = _mixed(whole)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                yield np.unique(whole[a:b - SHINGLE + 1])
            elif b > a:
                short = hashed[a:b] + factors[SHINGLE:SHINGLE + b - a]
                yield _mixed((_mixed(short) * factors[:b - a]).sum(keepdims=True)
                             + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _circle() -> np.ndarray:
    """The second permutation, with its beginning repeated at the end; one row for each point."""
    turn = np.random.default_rng(SEED + 1).permutation(CIRCLE).astype(np.int32)
    turn = np.concatenate([turn, turn[:BANDS * ROWS]])
    return np.lib.stride_tricks.sliding_window_view(turn, BANDS * ROWS)


def signature(hashes: np.ndarray, circle: np.ndarray) -> np.ndarray:
    """The least value of the set's shingles in each coordinate."""
    points = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CIRCLE_BITS)
    least = np.full(BANDS * ROWS, CIRCLE, np.int32)
    for at in range(0, len(points), CHUNK):
        np.minimum(least, circle[points[at:at + CHUNK]].min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band of a signature and the band's number."""
    factors = _factors(ROWS + 1)
    values = least.astype(np.uint64).reshape(BANDS, ROWS)
    return _mixed((_mixed(values + factors[:ROWS]) * factors[:ROWS]).sum(axis=1)
                  + np.arange(BANDS, dtype=np.uint64) * factors[ROWS]).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands`` of every row; key and bands are null without words.

    ``set_key`` is a 128-bit hash of the full set.
    """
    @lean
    def run(batches):
        circle = _circle()
        for batch in batches:
            sizes, keys, found = [], [], []
            for s in shingle_sets(text_of(batch)):
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(bands(signature(s, circle)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _full_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles`` (the full set) of every row with words."""
    @lean
    def run(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(text_of(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(one, "a").join(two, "b").select(
        "a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("total"))
    return joined.where(DENOMINATOR * F.col("shared") >= NUMERATOR * F.col("total")).select("a", "b")


def _fit(n, m):
    """Whether sets of these sizes can be similar enough."""
    return DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)


def _open_spokes(spokes: DataFrame, joined: DataFrame) -> DataFrame:
    """``hub, rep`` once for all bands whose members are in several components."""
    mine = joined.select(F.col("node").alias("rep"), "component")
    hubs = joined.select(F.col("node").alias("centre"), F.col("component").alias("hub_component"))
    named = (spokes.withColumn("centre", F.col("hub.rep")).join(mine, "rep", "left")
             .join(hubs, "centre", "left").withColumn("own", F.coalesce("component", "rep"))
             .withColumn("other", F.coalesce("hub_component", "centre")))
    mixed = named.groupBy("band").agg(
        F.min(F.least("own", "other")).alias("low"),
        F.max(F.greatest("own", "other")).alias("high")).where("low < high")
    return named.join(mixed, "band", "left_semi").select(F.col("centre").alias("hub"), "rep").distinct()


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For ``hub, rep``: sizes, the difference (added shingles first, then removed), and ``far``,
    whether the two are not linked."""
    one = sets.select("rep", F.col("shingles").alias("x"))
    two = sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("y"))
    return (pairs.join(one, "rep").join(two, "hub").select(
        "hub", "rep", F.size("x").alias("n"), F.size("y").alias("m"),
        F.concat(F.array_sort(F.array_except("x", "y")), F.array_sort(F.array_except("y", "x")))
        .alias("delta"))
        .withColumn("far", _SPREAD * F.size("delta") > F.col("n") + F.col("m")))


# |A & B| / |A | B| >= 3/4 means that |A ^ B| <= (|A| + |B|) / 7.
_SPREAD = (DENOMINATOR + NUMERATOR) // (DENOMINATOR - NUMERATOR)


def _across(apart: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that may be linked, of one hub but of different components.

    One of them is far from the hub. Only shingles that a hub's rows of several components have can
    be shared by such a pair; all others take the first places of a difference, then the rarest
    come first. The bounds of the prefix argument, where x and y stand for 7 d_x - |x|: a pair
    shares at least (x + y) / 14, a far row has x > m, and every row x >= -m.
    """
    named = apart.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "hub", "rep", "n", "m", "far", F.size("delta").alias("d"), F.xxhash64("delta").alias("key"),
        F.coalesce("component", "rep").alias("component"), F.explode("delta").alias("shingle"))
    split = named.groupBy("hub", "shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")
        ).where("low < high").select("hub", "shingle", "rows")
    # A row that an id has twice is one.
    held = named.join(split, ["hub", "shingle"]).groupBy(
        "hub", "rep", "n", "m", "far", "d", "key", "component").agg(
        F.sort_array(F.collect_set(F.struct("rows", "shingle"))).alias("held"))
    d, n, m, place = F.col("d"), F.col("n"), F.col("m"), F.col("d") - F.size("held")
    some = materialize(held.where(2 * _SPREAD * place <= _SPREAD * d + n + m), "places")
    placed = some.select("hub", "rep", "n", "m", "far", "d", "component", place.alias("before"),
                         F.posexplode("held").alias("at", "it")).select(
        "*", (F.col("before") + F.col("at")).alias("place"), F.col("it.shingle").alias("shingle"))
    place = 2 * _SPREAD * F.col("place")
    far = placed.where(F.col("far") & (place <= _SPREAD * d + n + m)).select(
        "hub", "shingle", F.col("rep").alias("a"), n.alias("na"), d.alias("da"),
        F.col("component").alias("ca"), F.col("place").alias("i"))
    near = placed.where(place < _SPREAD * d + n - m).select(
        "hub", "shingle", F.col("rep").alias("b"), n.alias("nb"), d.alias("db"),
        F.col("component").alias("cb"), F.col("place").alias("j"), F.col("far").alias("both"))
    shared = _SPREAD * (F.col("da") + F.col("db")) - F.col("na") - F.col("nb")
    met = far.join(near, ["hub", "shingle"]).where(
        (F.col("ca") != F.col("cb")) & (~F.col("both") | (F.col("a") > F.col("b")))
        & _fit(F.col("na"), F.col("nb"))
        & (2 * _SPREAD * (F.col("da") - F.col("i")) >= shared)
        & (2 * _SPREAD * (F.col("db") - F.col("j")) >= shared))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked if ``100 * |A & B| >= 75 * |A | B|``. ``component_id`` is the smallest id
    that links lead to, the own one included; ``kept`` tells whether it is the own one. Null and
    blank texts have an empty set and are linked with nothing. Rows without ``doc_id`` are
    linked with nothing, have no component and are kept. Rows with one id count as one document
    that has the links of all of them. Only ``doc_id`` and ``text`` are used.
    """
    known = materialize(sketches(docs), "sketches")
    filled = known.where("doc_id is not null and set_key is not null")
    classes = materialize(filled.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(banded.join(shared, "band"), "bands")
    weights = members.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighed = members.join(weights, "rep")
    hubs = weighed.groupBy("band").agg(F.max(F.struct(
        "weight", (-F.col("rep")).alias("back"), "rep", "n")).alias("hub"))
    spokes = materialize(weighed.join(hubs, "band").where(F.col("hub.rep") != F.col("rep"))
                         .select("band", "rep", "n", "hub"), "spokes")
    sets = materialize(_full_sets(docs.select("doc_id", "text").join(
        weights.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
        .select(F.col("doc_id").alias("rep"), "shingles"), "sets")
    # First each member's weightiest hub of fitting size.
    first = spokes.where(_fit(F.col("n"), F.col("hub.n"))).groupBy(F.col("rep").alias("a")).agg(
        F.max("hub").alias("hub")).select("a", F.col("hub.rep").alias("b"))
    links = materialize(_confirmed(first, sets), "confirmed")
    rest = _open_spokes(spokes, components(links))
    apart = materialize(_differences(rest, sets), "differences")
    again = apart.where("not far").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    links = materialize(links.unionByName(again), "confirmed")
    more = _confirmed(_across(apart, components(links)), sets)
    # Rows with one id but different sets tie their classes together.
    several = filled.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key")
                                           .alias("high")).where("low < high")
    ties = (filled.join(several, "doc_id", "left_semi")
            .join(classes.select("set_key", "rep"), "set_key").where("doc_id <> rep"))
    final = components(links.unionByName(more).unionByName(
        ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    named = classes.select("set_key", "rep").join(final, F.col("rep") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"))
    out = known.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose document is linked with one of a smaller id."""
    out = materialize(link(docs), "linked").where("not kept").select("doc_id").distinct()
    return docs.join(out.hint("merge"), docs["doc_id"] == out["doc_id"], "left_anti")
