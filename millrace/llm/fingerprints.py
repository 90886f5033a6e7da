"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, in SQL functions.

Every paragraph (line with content) is hashed to a wide vector and the vectors of a text are
summed, each coordinate modulo a power of two. Sums do not depend on the order of paragraphs,
and adding or taking away a paragraph's vector updates a fingerprint without the other texts.

The vector of a paragraph has two parts:

* ``exact``: 16 coordinates of 32 bits, hashed from the whole paragraph, modulo 2^32. Equal
  multisets of paragraphs have equal sums; different ones differ except with negligible chance.
* ``signs``: one bit for each of 126 coordinates, summed over the paragraph's pieces (runs of at
  most eight words that no punctuation interrupts), modulo 2^21. Together with the number of
  pieces a sum of bits is a sum of +1 and -1, so the squared difference of two fingerprints
  estimates how many pieces the texts do not share (``likeness``).

Null and blank texts are the empty multiset: all coordinates are 0. Repeated paragraphs count as
often as they stand in the text. Counts wrap beyond 2^21 pieces (some 80 MB of text), which
leaves equality right and only likeness meaningless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.session import materialize

EXACT = 16                      # coordinates of 32 bits
BITS = 21                       # of a sign counter; a long holds three of them
LOW32 = (1 << 32) - 1
LOW = (1 << BITS) - 1
LOWEST = 1 | 1 << BITS | 1 << 2 * BITS      # the lowest bit of each counter
PIECE = r"(?:[^\s.,;:!?]++[ \t]*+){1,4}+"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _sum(items: Column, step) -> Column:
    return F.aggregate(items, _long(0), step)


def _bits(hashes: Column, shift: int) -> Column:
    """Three counters: of the bits ``shift``, ``shift + 21`` and ``shift + 42``."""
    return _sum(hashes, lambda s, h: s + F.shiftrightunsigned(h, shift).bitwiseAND(_long(LOWEST)))


def fingerprint(text: Column) -> Column:
    """``struct<exact array<bigint>, signs array<bigint>, pieces bigint>`` of a text."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(text, "[\r\n]+"), lambda p: F.length(F.trim(p)) > 0)
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.array_distinct(F.transform(
        F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda q: F.xxhash64(F.rtrim(q))))))
    # Bound to a lambda variable, so that the hashes are made once for a text.
    hashes = F.array(F.struct(F.transform(paragraphs, lambda p: F.xxhash64(p)).alias("p"),
                              pieces.alias("q")))

    def exact(hashes, i):
        return _sum(hashes, lambda s, h: (s + F.xxhash64(h, F.lit(i)).bitwiseAND(_long(LOW32)))
                    .bitwiseAND(_long(LOW32)))

    def summed(x):
        other = F.transform(x["q"], lambda h: F.xxhash64(h))
        return F.struct(
            F.array(*[exact(x["p"], i) for i in range(EXACT)]).alias("exact"),
            F.element_at(F.transform(F.array(other), lambda r: F.array(
                *[_bits(x["q"], i) for i in range(BITS)],
                *[_bits(r, i) for i in range(BITS)])), 1).alias("signs"),
            F.size(x["q"]).cast("long").alias("pieces"))

    return F.element_at(F.transform(hashes, summed), 1)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or with ``sign=-1`` of a's less b's."""
    def counters(x, y):
        parts = [(F.shiftrightunsigned(x, k).bitwiseAND(_long(LOW))
                  + sign * F.shiftrightunsigned(y, k).bitwiseAND(_long(LOW)))
                 .bitwiseAND(_long(LOW)) for k in (0, BITS, 2 * BITS)]
        return (parts[0].bitwiseOR(F.shiftleft(parts[1], BITS))
                .bitwiseOR(F.shiftleft(parts[2], 2 * BITS)))

    return F.struct(
        F.zip_with(a["exact"], b["exact"],
                   lambda x, y: (x + sign * y).bitwiseAND(_long(LOW32))).alias("exact"),
        F.zip_with(a["signs"], b["signs"], counters).alias("signs"),
        (a["pieces"] + sign * b["pieces"]).alias("pieces"))


def as_text(f: Column) -> Column:
    """All coordinates as lower-case hexadecimal digits."""
    def digits(items, n):
        return F.array_join(F.transform(items, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")

    return F.concat(digits(f["exact"], 8), F.lit("-"), digits(f["signs"], 16), F.lit("-"),
                    F.lower(F.hex(f["pieces"])))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common pieces, 0 to 1: 1 exactly if the fingerprints are equal.

    With c shared pieces of n and m it is about 2c / (n + m), with a standard error of some
    0.1. Two empty texts are equal; an empty and a filled one have likeness 0.
    """
    def sums(x):
        def signed(v, n, k):
            return (2 * F.shiftrightunsigned(v, k).bitwiseAND(_long(LOW)) - n).cast("double")

        def step(s, pair):
            u = [(signed(pair["x"], x["n"], k), signed(pair["y"], x["m"], k))
                 for k in (0, BITS, 2 * BITS)]
            return F.struct(
                (s["d"] + sum((p - q) * (p - q) for p, q in u)).alias("d"),
                (s["t"] + sum(p * p + q * q for p, q in u)).alias("t"))

        pairs = F.zip_with(x["a"], x["b"], lambda p, q: F.struct(p.alias("x"), q.alias("y")))
        return F.aggregate(pairs, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("t")), step)

    both = F.array(F.struct(a["signs"].alias("a"), b["signs"].alias("b"),
                            a["pieces"].alias("n"), b["pieces"].alias("m")))
    s = F.element_at(F.transform(both, sums), 1)
    return F.when((a["exact"] == b["exact"]) & (a["signs"] == b["signs"])
                  & (a["pieces"] == b["pieces"]), 1.0).otherwise(
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 1e-9), 1.0 - s["d"] / F.when(
            s["t"] > 0, s["t"]))), F.lit(0.0)))


def following(ids: DataFrame, key: str) -> DataFrame:
    """Each distinct ``key`` with the next larger one as ``_next``; the last gets the first.

    Keys are dealt out by range; only the first key of each range, one row for each partition,
    is brought together and broadcast.
    """
    placed = materialize(ids.repartitionByRange(key)
                         .select("*", F.spark_partition_id().alias("_range")), "ranges")
    firsts = placed.groupBy("_range").agg(F.min(key).alias("_first"))
    ends = firsts.select("_range", F.coalesce(
        F.lead("_first").over(Window.orderBy("_range")),
        F.min("_first").over(Window.orderBy("_range").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("_end"))
    inner = F.lead(key).over(Window.partitionBy("_range").orderBy(key))
    return (placed.withColumn("_next", inner).join(F.broadcast(ends), "_range")
            .withColumn("_next", F.coalesce("_next", "_end")).drop("_range", "_end"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The last quarter (rounded down) of a text's code points is replaced by the first as many of
    the next document's, by ascending ``doc_id``; the last document's next is the first. Rows
    without ``doc_id`` come before all others. Of several rows with one ``doc_id`` each is
    fingerprinted; the one with the smallest beginning stands for them as a next document.
    Other columns than ``doc_id`` and ``text`` are ignored.
    """
    at = F.struct(F.col("doc_id").isNotNull().alias("known"),
                  F.coalesce(F.col("doc_id"), _long(0)).alias("id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(at.alias("_at"), text.alias("_text"), fingerprint(text).alias("_own"))
    lengths = (docs.select(at.alias("_at"), F.floor(F.length(text) / 4).cast("int").alias("_n"))
               .groupBy("_at").agg(F.max("_n").alias("_n")))
    wanted = following(lengths, "_at").select(F.col("_next").alias("_at"),
                                              F.col("_at").alias("_for"), "_n")
    heads = (own.join(wanted, "_at").select("_for", F.struct(
        F.expr("left(_text, _n)").alias("text"), F.col("_own").alias("own")).alias("_head"))
        .groupBy("_for").agg(F.min("_head").alias("_head"))
        .withColumnRenamed("_for", "_at"))
    quarter = F.floor(F.length("_text") / 4).cast("int")
    both = (own.join(heads, "_at")
            .withColumn("_quarter", quarter)
            .withColumn("_edited", F.expr(
                "concat(left(_text, length(_text) - _quarter), left(_head.text, _quarter))"))
            .select("_at", F.length("_text").cast("long").alias("n_chars"), "_own",
                    F.col("_head.own").alias("_next"),
                    F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                    fingerprint(F.col("_edited")).alias("_changed")))
    return both.select(
        F.when(F.col("_at.known"), F.col("_at.id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"))
