"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes.

The flow network has one node for each old shard and one for each new shard: a few numbers,
whatever the size of the data. Bytes that stay cost nothing, bytes that move cost one each. The
solved flow says how many bytes of old shard i belong to new shard j. The rows of an old shard,
in the order of ``doc_id``, are cut along its flows: a row goes where the middle of its bytes
falls. So each boundary between two shards errs by half a row at most, and nothing is moved that
the flow does not move.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.session import materialize


def cheapest_flow(old: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes to bring from each old to each new shard: least moved, every capacity met.

    Successive shortest paths with potentials; an edge (i, j) costs 0 if i == j and else 1.
    Ties are broken by shard number. The sums of both sides have to be equal.
    """
    if sum(old.values()) != sum(capacity.values()):
        raise ValueError("capacities must add up to the bytes there are")
    left, room = dict(sorted(old.items())), dict(sorted(capacity.items()))
    flow: dict[tuple[int, int], int] = {}
    dist_to = {("o", i): 0 for i in left} | {("n", j): 0 for j in room}
    while any(left.values()):
        # Dijkstra over reduced costs, from every old shard with bytes left.
        best = {("o", i): 0 for i, v in left.items() if v}
        via: dict = {}
        heap = [(0, node) for node in best]
        heapq.heapify(heap)
        while heap:
            d, node = heapq.heappop(heap)
            if d > best[node]:
                continue
            side, k = node
            if side == "o":
                steps = [(("n", j), int(k != j)) for j in room]
            else:
                steps = [(("o", i), -int(i != k)) for i in left if flow.get((i, k))]
            for to, cost in steps:
                reach = d + cost + dist_to[node] - dist_to[to]
                if to not in best or reach < best[to]:
                    best[to], via[to] = reach, node
                    heapq.heappush(heap, (reach, to))
        goal = min((best[n] + dist_to[n], n) for n in best if n[0] == "n" and room[n[1]])[1]
        path, node = [], goal
        while node in via:
            path.append((via[node], node))
            node = via[node]
        amount = min([left[node[1]], room[goal[1]],
                      *(flow[(b[1], a[1])] for a, b in path if a[0] == "n")])
        for a, b in path:
            edge, sign = ((a[1], b[1]), 1) if a[0] == "o" else ((b[1], a[1]), -1)
            flow[edge] = flow.get(edge, 0) + sign * amount
        left[node[1]] -= amount
        room[goal[1]] -= amount
        most = max(best.values())
        dist_to = {n: d + best.get(n, most) for n, d in dist_to.items()}
    return {k: v for k, v in sorted(flow.items()) if v}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    """``total`` bytes over ``shards``, at most one byte apart."""
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def _running(rows: DataFrame, group: str, order: list, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before it in its group.

    Sorted by range, so that a large group is cut over many tasks; sums of the cuts before
    are one number for each range and group.
    """
    cut = materialize(rows.repartitionByRange(group, *order)
                      .select("*", F.spark_partition_id().alias("_range")), "running")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(group, "_range").agg(F.sum(value).alias("_sum")).select(
        group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    inner = (Window.partitionBy(group, "_range").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    return (cut.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(carry, [group, "_range"]).withColumn(out, F.col(out) + F.col("_carry"))
            .drop("_range", "_carry"))


def reshard(docs: DataFrame, old_shards: int, shards: int) -> DataFrame:
    """Assign every row to a shard so that sizes are near equal and the fewest bytes move.

    ``docs`` has ``doc_id`` and ``text``; its old shard is ``doc_id`` modulo ``old_shards`` (0
    without id). The size of a row is its UTF-8 bytes plus 1; a null text has none. Returns
    ``doc_id, size, text_crc32, old_shard, shard, slot``: ``slot`` numbers the rows of a shard
    from 0 without gaps, in the order of (old shard, doc_id, checksum). Repeated rows are
    assigned each on its own; of equal rows any may come first, which leaves the result the
    same. Law: ``bytes``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.pmod("doc_id", F.lit(old_shards)), F.lit(0)).cast("int").alias("old_shard"))
    placed = _running(rows, "old_shard", ["doc_id", "text_crc32", "size"], "size", "_before")
    placed = materialize(placed, "placed")
    # One number for each old shard.
    sizes = {r["old_shard"]: r["bytes"] for r in
             placed.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    flow = cheapest_flow(sizes, equal_capacities(sum(sizes.values()), shards))
    cuts: dict[int, list] = {}
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        end = cuts[i][-1][0] + amount if i in cuts else amount
        cuts.setdefault(i, []).append((end, j))
    middle = F.col("_before") * 2 + F.col("size")
    shard = F.lit(0)
    for i, ends in cuts.items():
        target = F.lit(ends[-1][1])
        for end, j in reversed(ends[:-1]):
            target = F.when(middle <= 2 * end, j).otherwise(target)
        shard = F.when(F.col("old_shard") == i, target).otherwise(shard)
    moved = placed.select("doc_id", "size", "text_crc32", "old_shard", shard.alias("shard"),
                          F.lit(1).cast("long").alias("_one"))
    return _running(moved, "shard", ["old_shard", "doc_id", "text_crc32", "size"], "_one",
                    "slot").drop("_one")


def rewrite(docs: DataFrame, shard: str, old_shard: str, old_path: str, new_path: str) -> list[int]:
    """Write the files of the shards whose rows changed, below ``new_path/shard=N``.

    ``docs`` carries both shard numbers. Returns the numbers of the shards that were written;
    all others keep their files below ``old_path``. Nothing is written for empty shards.
    """
    changed = [r["s"] for r in docs.where(F.col(shard) != F.col(old_shard))
               .select(F.explode(F.array(shard, old_shard)).alias("s")).distinct()
               .orderBy("s").collect()]          # shard numbers only
    if old_path == new_path:
        raise ValueError("rewrite to a new folder: a reader may still use the old one")
    affected = docs.where(F.col(shard).isin(changed) if changed else F.lit(False))
    (affected.drop(old_shard).repartition(shard, F.pmod(F.xxhash64("doc_id"), F.lit(16)))
     .write.partitionBy(shard).parquet(new_path))
    return changed
