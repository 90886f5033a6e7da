"""Exact deduplication: groups of one 128-bit content hash, bytes compared inside the groups.

Two texts are equal if they are the same after deleting every character of ``[\\x20\\x09-\\x0D]``.
Each row gets the MD5 of that normalised text; only ids, lengths and hashes travel for the groups.
Then the normalised texts themselves are grouped by hash and bytes, copies being put together
before the shuffle, so that a text with a billion copies is sent once by each task. A hash under
which two different texts stand is a collision; its rows alone are told apart by their bytes, all
others by the hash.

Of equal texts the row with the most code points in its original text stays, of these the one with
the smallest ``doc_id``. A null text counts as empty, and all blank texts are equal. Rows without
``doc_id`` come after those with one; of rows that agree in length and id, any one stays.
Other columns than ``doc_id`` and ``text`` are ignored by ``grouped`` and kept by ``distinct``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import materialize

SPACES = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _best() -> Column:
    """The row that stays: longest original text, then smallest id, then any."""
    return F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("missing"),
                          "doc_id", "row")).alias("best")


def _groups(rows: DataFrame, *by: str) -> DataFrame:
    """The groups of two rows or more."""
    return rows.groupBy(*by).agg(F.count("*").alias("group_size"), _best()).where("group_size > 1")


def grouped(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` and ``row, sha256`` for every row of ``docs``.

    ``keep_id`` is the id of the row that stays, ``kept`` tells whether it is this one.
    ``sha256`` is of the normalised text; ``row`` numbers the rows of the written table that the
    result is made from.
    """
    text = normalised(F.col("text"))
    bare = docs.select("doc_id", "text")
    rows = materialize(bare.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        hashed(text).alias("key"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha256"),
        F.monotonically_increasing_id().alias("row")), "hashed")
    groups = materialize(_groups(rows, "key"), "groups")
    texts = bare.select(hashed(text).alias("key"), text.alias("norm")).distinct()
    collided = materialize(texts.groupBy("key").agg(F.count("*").alias("texts"))
                           .where("texts > 1").select("key"), "collided")
    if collided.isEmpty():
        return _named(rows, groups, ["key"])
    # Rows of those hashes get their bytes; they are found by what their texts hash to.
    told = (bare.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                        hashed(text).alias("key"), text.alias("norm"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha256"),
                        F.monotonically_increasing_id().alias("row"))
            .join(collided.hint("merge"), "key", "left_semi"))
    told = materialize(told, "told")
    return _named(rows.join(collided, "key", "left_anti"), groups, ["key"]).unionByName(
        _named(told, _groups(told, "key", "norm"), ["key", "norm"]))


def _named(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows of no group stand alone. Both sides grow with the data, so neither is broadcast; the
    rows of a hot group are dealt out by the adaptive split of a skewed join."""
    alone = F.col("best").isNull()
    return rows.join(groups.hint("merge"), by, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), "row", "sha256")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too."""
    return grouped(docs).select("doc_id", "keep_id", "group_size", "kept",
                                F.lower(F.hex("sha256")).alias("text_sha256"))


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each group.

    Here the bytes are the grouping key themselves, copies put together before the shuffle.
    """
    placed = materialize(docs.select(F.struct("*").alias("_row"),
                                     F.monotonically_increasing_id().alias("_place")), "placed")
    text, doc_id = F.col("_row.text"), F.col("_row.doc_id")
    best = placed.groupBy(content_hash(normalised(text)).alias("key"), normalised(text).alias("norm")).agg(
        F.min(F.struct((-F.length(F.coalesce(text, F.lit("")))).alias("shorter"),
                       doc_id.isNull().alias("missing"), doc_id.alias("id"), "_place")).alias("best"))
    keep = best.select(F.col("best._place").alias("_place"))
    return placed.join(keep.hint("merge"), "_place", "left_semi").select("_row.*")
