"""Ordered computation (ranks, running sums, fills) safe for groups of any size.

A plain window gathers each group in one task. That is used only after a count
has shown that the largest group is small. Otherwise the rows are range
partitioned by (group, order), so a large group spans many *chunks*; each chunk
is computed on its own, and a carry table brings in what came before it. A chunk
can continue at most one group of the chunk before, so the carry table has fewer
rows than there are chunks; while those are few, it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import col, unused
from ..session import materialize

# Largest group (rows) that a single window task may be given.
GROUP_ROWS = 2_000_000
# Most bytes of its cells, where whole cells are gathered.
GROUP_BYTES = 256 << 20
# Up to so many chunks a carry table, with fewer rows than chunks, is broadcast.
FEW_CHUNKS = 20_000

METHODS = ("row_number", "rank", "dense_rank")


class Sizes(NamedTuple):
    """Rows in the biggest group and in all groups together, and the same of bytes."""

    largest: int
    total: int
    most_bytes: int = 0
    total_bytes: int = 0

    def fit(self, limit: int | None) -> bool:
        return (self.largest <= (GROUP_ROWS if limit is None else limit)
                and self.most_bytes <= GROUP_BYTES)

    @property
    def chunks(self) -> int:
        """Chunks of which each is as small as a group that one task may be given."""
        return max(-(-self.total // GROUP_ROWS), -(-self.total_bytes // GROUP_BYTES))


def sizes(df: DataFrame, keys: Sequence[str], weigh: Sequence[str] = ()) -> Sizes:
    """Count the groups, merged map-side; only a few numbers reach the driver.

    ``weigh`` names columns whose cells are gathered, and whose bytes count too.
    """
    weight = reduce(add, [F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)).cast("long")
                          for c in weigh], F.lit(0).cast("long"))
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"),
                                                     F.sum(weight).alias("b"))
    return Sizes(*[n or 0 for n in counts.agg(F.max("n"), F.sum("n"), F.max("b"), F.sum("b")).first()])


def order_key(names: Sequence[str]) -> Column:
    """One orderable value for ``min_by``/``max_by``, never null itself; nulls in it come first."""
    return F.struct(*[col(n) for n in names])


def ordering(c: Column, ascending: bool) -> Column:
    """Nulls come last in both directions."""
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: str,
              size: Sizes, label: str) -> DataFrame:
    """Range partition by (keys, order) and fix the result, with its chunk number.

    There are enough chunks for each to be as small as a group one task may be given.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(usual, size.chunks)
    split = df.repartitionByRange(n, *[col(k).asc_nulls_first() for k in keys], *order)
    return materialize(split.withColumn(chunk, F.spark_partition_id()), label)


def _before(keys: Sequence[str], chunk: str):
    """Window over one group's earlier chunks: at most one row per chunk."""
    return (Window.partitionBy(*[col(k) for k in keys]).orderBy(col(chunk))
            .rowsBetween(Window.unboundedPreceding, -1))


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str], chunk: str,
            total: int) -> DataFrame:
    """Left join the carry table; its own columns come back under fresh names.

    Beyond ``FEW_CHUNKS`` chunks it is shuffled like any other table.
    """
    renamed = {n: f"__c_{i}" for i, n in enumerate([chunk, *keys])}
    small = carry.withColumnsRenamed(renamed)
    if total <= FEW_CHUNKS * GROUP_ROWS:
        small = F.broadcast(small)
    on = [col(n).eqNullSafe(col(m)) for n, m in renamed.items()]
    return rows.join(small, on, "left").drop(*renamed.values())


def number(df: DataFrame, rank_by: str | None, keys: Sequence[str], out: str, *,
           method: str = "row_number", ascending: bool = True,
           order_by: Sequence[str] = (), max_group_rows: int | None = None) -> DataFrame:
    """Add ``row_number``, ``rank`` or ``dense_rank`` within ``keys`` as column ``out``.

    ``order_by`` breaks ties and has to make row numbers unique; it does not
    affect ``rank`` and ``dense_rank``.
    """
    lead = [ordering(col(rank_by), ascending)] if rank_by else []
    ties = [col(o).asc_nulls_first() for o in order_by]
    size = sizes(df, keys)
    if size.fit(max_group_rows):
        by = lead + (ties if method == "row_number" else [])
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*by)
        return df.withColumn(out, getattr(F, method)().over(w).cast("long"))

    chunk = unused(df, "chunk")
    if not ties:
        # Equal values may fill many chunks: spread them by content and by input task.
        ties = [F.xxhash64(*[col(c) for c in df.columns]), F.spark_partition_id()]
    rows = in_chunks(df, keys, lead + ties, chunk, size, "rank")
    local = Window.partitionBy(col(chunk), *[col(k) for k in keys])
    if method == "row_number":
        counts = rows.groupBy(chunk, *[col(k) for k in keys]).agg(
            F.count(F.lit(1)).alias("__n"))
        carry = (counts.withColumn("__base", F.sum("__n").over(_before(keys, chunk)))
                 .filter("__base is not null").drop("__n"))
        here = F.row_number().over(local.orderBy(*lead, *ties)).cast("long")
        return (_attach(rows.withColumn(out, here), carry, keys, chunk, size.total)
                .withColumn(out, (col(out) + F.coalesce(F.col("__base"), F.lit(0))))
                .drop(chunk, "__base"))

    v = col(rank_by)
    runs = rows.groupBy(chunk, *[col(k) for k in keys], v).agg(F.count(F.lit(1)).alias("__run"))
    nulls = F.sum(F.when(v.isNull(), F.col("__run")))
    last, last_run = ((F.max(v), F.max_by("__run", v)) if ascending
                      else (F.min(v), F.min_by("__run", v)))
    chunks = runs.groupBy(chunk, *[col(k) for k in keys]).agg(
        F.sum("__run").alias("__n"),
        F.count(F.lit(1)).alias("__values"),
        (F.min(v) if ascending else F.max(v)).alias("__first"),
        F.when(nulls.isNull(), last).alias("__last"),
        (F.sum("__run") - F.coalesce(nulls, last_run) + 1).alias("__last_at"),
    )
    nth = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(chunk))
    before = _before(keys, chunk)
    carry = (
        chunks
        .withColumn("__goes_on", F.lag(F.lit(True)).over(nth).isNotNull()
                    & F.lag("__last").over(nth).eqNullSafe(F.col("__first")))
        .withColumn("__base", F.sum("__n").over(before))
        # Rank of the chunk's last value, when that value starts in this chunk.
        .withColumn("__starts", F.when(
            ~(F.col("__goes_on") & F.col("__first").eqNullSafe(F.col("__last"))),
            F.coalesce(F.col("__base"), F.lit(0)) + F.col("__last_at")))
        .withColumn("__carried", F.last("__starts", ignorenulls=True).over(before))
        .withColumn("__dense_base", F.sum("__values").over(before) - F.sum(
            F.col("__goes_on").cast("long")).over(nth.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("__base is not null")
        .select(chunk, *[col(k) for k in keys], "__first", "__goes_on", "__base",
                "__carried", "__dense_base")
    )
    local = local.orderBy(*lead)
    here = (F.rank() if method == "rank" else F.dense_rank()).over(local).cast("long")
    joined = _attach(rows.withColumn(out, here), carry, keys, chunk, size.total)
    if method == "rank":
        value = F.when(F.col("__goes_on") & v.eqNullSafe(F.col("__first")), F.col("__carried"))
        value = F.coalesce(value, col(out) + F.coalesce(F.col("__base"), F.lit(0)))
    else:
        value = col(out) + F.coalesce(F.col("__dense_base"), F.lit(0))
    return joined.withColumn(out, value).drop(
        chunk, "__first", "__goes_on", "__base", "__carried", "__dense_base")


def carry_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str],
                 order_by: Sequence[str], *, backward: bool = False,
                 max_group_rows: int | None = None) -> DataFrame:
    """Fill nulls with the previous (or next) non-null value in ``order_by`` order."""
    if not columns:
        return df
    order = [col(o) for o in order_by]

    def fill(rows: DataFrame, by: Sequence[Column]) -> DataFrame:
        # Backwards is forwards in the opposite order: a growing frame, one pass per group.
        along = [o.desc_nulls_last() if backward else o.asc_nulls_first() for o in order]
        w = (Window.partitionBy(*by).orderBy(*along)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumns({c: F.last(col(c), ignorenulls=True).over(w) for c in columns})

    by_keys = [col(k) for k in keys]
    size = sizes(df, keys)
    if size.fit(max_group_rows):
        return fill(df, by_keys)

    chunk = unused(df, "chunk")
    rows = in_chunks(df, keys, [o.asc_nulls_first() for o in order], chunk, size, "fill")
    edge = F.min_by if backward else F.max_by
    position = order_key(order_by)
    ends = rows.groupBy(chunk, *by_keys).agg(*[
        edge(col(c), F.when(col(c).isNotNull(), position)).alias(f"__v{i}")
        for i, c in enumerate(columns)])
    beyond = Window.partitionBy(*by_keys).orderBy(
        col(chunk).desc() if backward else col(chunk).asc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__v{i}" for i in range(len(columns))]
    carry = (ends.withColumns({n: F.last(n, ignorenulls=True).over(beyond) for n in names})
             .filter(" or ".join(f"{n} is not null" for n in names)))
    joined = _attach(fill(rows, [col(chunk), *by_keys]), carry, keys, chunk, size.total)
    return (joined.withColumns({c: F.coalesce(col(c), F.col(n)) for c, n in zip(columns, names)})
            .drop(chunk, *names))


def running_sum(df: DataFrame, value: str, keys: Sequence[str], order_by: str, out: str, *,
                max_group_rows: int | None = None) -> DataFrame:
    """Running total of ``value`` up to and including each row, per group."""
    order = col(order_by).asc_nulls_first()
    by_keys = [col(k) for k in keys]

    def total(rows: DataFrame, by: Sequence[Column]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(out, F.sum(col(value)).over(w))

    size = sizes(df, keys)
    if size.fit(max_group_rows):
        return total(df, by_keys)
    chunk = unused(df, "chunk")
    rows = in_chunks(df, keys, [order], chunk, size, "sum")
    carry = (rows.groupBy(chunk, *by_keys).agg(F.sum(col(value)).alias("__s"))
             .withColumn("__base", F.sum("__s").over(_before(keys, chunk)))
             .filter("__base is not null").drop("__s"))
    return (_attach(total(rows, [col(chunk), *by_keys]), carry, keys, chunk, size.total)
            .withColumn(out, col(out) + F.coalesce(F.col("__base"), F.lit(0)))
            .drop(chunk, "__base"))


def quantile_middle(df: DataFrame, column: str, keys: Sequence[str], out: str, *,
                    max_group_rows: int | None = None) -> DataFrame:
    """Exact median of non-null ``column`` per group, as a table (keys, out).

    Counts per distinct value are merged map-side; the middle is then found from
    running counts, so neither a hot group nor a hot value lands in one task.
    """
    by_keys = [col(k) for k in keys]
    values = df.filter(col(column).isNotNull()).select(
        *by_keys, col(column).cast("double").alias("__x"))
    counts = values.groupBy(*by_keys, "__x").agg(F.count(F.lit(1)).alias("__n"))
    running = running_sum(counts, "__n", keys, "__x", "__upto", max_group_rows=max_group_rows)
    totals = values.groupBy(*by_keys).agg(F.count(F.lit(1)).alias("__rows"))
    if keys:
        renamed = {k: f"__k{i}" for i, k in enumerate(keys)}
        sized = running.join(
            totals.withColumnsRenamed(renamed),
            [col(k).eqNullSafe(F.col(n)) for k, n in renamed.items()]).drop(*renamed.values())
    else:
        sized = running.withColumn("__rows", totals.scalar())
    start = F.col("__upto") - F.col("__n")
    low, high = F.floor((F.col("__rows") - 1) / 2), F.floor(F.col("__rows") / 2)
    middle = sized.filter(((start <= low) & (low < F.col("__upto")))
                          | ((start <= high) & (high < F.col("__upto"))))
    return middle.groupBy(*by_keys).agg(((F.min("__x") + F.max("__x")) / 2).alias(out))
