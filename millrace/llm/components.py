"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import materialize


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFF))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns ``a`` and ``b``, same type).

    ``component`` is the smallest node that can be reached. Links with a null and links of a
    node to itself join nothing. Each round is four shuffles whose rows are pairs; minima are
    taken map-side, neighbours are never gathered, and the pairs are written each round. Only a
    count and two checksums come to the driver. The number of rounds grows with the logarithm of
    the largest component.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                         F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
