"""Aggregation, ranking, deduplication and the join-filter-aggregate composite."""

from __future__ import annotations

from pyspark.sql import functions as F

import millrace as mr

from .registry import Tables, query

# Orders with a null in the grouping column and in the value column.
GAPPY = """(select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as status, o_orderpriority,
    case when o_orderpriority = '3-MEDIUM' then null else o_totalprice end as price,
    case when o_orderstatus = 'F' then null else o_orderpriority end as note from orders)"""


def gappy(t: Tables):
    return t.orders.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        "o_orderpriority",
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("note"))


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query("aggregate_basic", f"""
    select status, o_orderpriority, round(coalesce(sum(price), 0), 2) as price_sum,
        count(price) as price_count, round(avg(price), 3) as price_mean,
        min(price) as price_min, max(price) as price_max, count(*) as orders
    from {GAPPY} where status is not null group by 1, 2""")
def aggregate_basic(t):
    out = mr.aggregate(gappy(t), ["status", "o_orderpriority"], [
        ("price", "sum"), ("price", "count"), ("price", "mean"), ("price", "min"),
        ("price", "max"), ("*", "count", "orders")])
    return rounded(rounded(out, 2, "price_sum"), 3, "price_mean")


@query("aggregate_product", """
    select l_orderkey, product(l_linenumber) as l_linenumber_prod from lineitem group by 1""")
def aggregate_product(t):
    return mr.aggregate(t.lineitem, ["l_orderkey"], [("l_linenumber", "prod")])


@query("aggregate_first_last", f"""
    select o_custkey, arg_min(note, o_orderkey) filter (note is not null) as note_first,
        arg_max(note, o_orderkey) filter (note is not null) as note_last
    from {GAPPY} group by 1""")
def aggregate_first_last(t):
    return mr.aggregate(gappy(t), ["o_custkey"], [("note", "first"), ("note", "last")],
                        order_by=["o_orderkey"])


@query("aggregate_first_last_null_order", f"""
    select o_custkey, first(note order by key nulls first) filter (note is not null) as note_first,
        last(note order by key nulls first) filter (note is not null) as note_last
    from (select *, nullif(o_orderkey, (select min(o_orderkey) from orders)) as key from {GAPPY})
    group by 1""")
def aggregate_first_last_null_order(t):
    """The first order of all has no order key, and comes first all the same."""
    key = F.nullif("o_orderkey", t.orders.agg(F.min("o_orderkey")).scalar())
    return mr.aggregate(gappy(t).withColumn("key", key), ["o_custkey"], [
        ("note", "first"), ("note", "last")], order_by=["key"])


CONCAT = f"""select o_custkey,
    coalesce(string_agg(note, '|' order by o_orderkey) filter (note is not null), '') as notes,
    count(*) as orders from {GAPPY} group by 1"""
CONCATS = [{"column": "note", "function": "concat", "output_column": "notes"},
           {"column": "*", "function": "count", "output_column": "orders"}]

query("aggregate_concat", CONCAT)(
    lambda t: mr.aggregate(gappy(t), ["o_custkey"], CONCATS, order_by=["o_orderkey"]))
query("aggregate_concat_chunked", CONCAT)(
    lambda t: mr.aggregate(gappy(t), ["o_custkey"], CONCATS, order_by=["o_orderkey"],
                           max_group_rows=0))

SPREAD = f"""select o_orderpriority, count(distinct o_custkey) as customers,
    round(stddev_samp(price), 4) as price_std, round(median(price), 4) as price_median,
    round(var_samp(price) / 1e6, 4) as price_var,
    round(stddev_samp(price) / sqrt(count(price)), 4) as price_sem
    from {GAPPY} group by 1"""


def spread(t, **options):
    out = mr.aggregate(gappy(t), ["o_orderpriority"], [
        ("o_custkey", "nunique", "customers"), ("price", "std"), ("price", "median"),
        ("price", "var"), ("price", "sem")], **options)
    out = out.withColumn("price_var", F.col("price_var") / 1e6)
    return rounded(out, 4, "price_std", "price_median", "price_var", "price_sem")


query("aggregate_nunique_std_median", SPREAD)(spread)
query("aggregate_median_chunked", SPREAD)(lambda t: spread(t, max_group_rows=0))


@query("aggregate_keys_only", f"select distinct status, o_orderpriority from {GAPPY}")
def aggregate_keys_only(t):
    return mr.aggregate(gappy(t), ["status", "o_orderpriority"])


@query("aggregate_lines", """
    select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
        round(sum(l_extendedprice), 2) as sum_price, round(avg(l_discount), 6) as avg_disc,
        count(*) as lines
    from lineitem where l_shipdate <= timestamp '2001-09-02' group by 1, 2""")
def aggregate_lines(t):
    lines = mr.filter_rows(t.lineitem, [("l_shipdate", "<=", "2001-09-02")])
    out = mr.aggregate(lines, ["l_returnflag", "l_linestatus"], [
        ("l_quantity", "sum", "sum_qty"), ("l_extendedprice", "sum", "sum_price"),
        ("l_discount", "mean", "avg_disc"), ("*", "count", "lines")])
    return rounded(rounded(out, 2, "sum_qty", "sum_price"), 6, "avg_disc")


# Ranking.
EVENTS = "(select event_id, event_type, user_id, nullif(value, 6.55) as value from events)"


def events(t: Tables):
    return t.events.select("event_id", "event_type", "user_id",
                           F.nullif("value", F.lit(6.55)).alias("value"))


def ranked(function: str, keys: str, direction: str, where: str = "", ties: str = "") -> str:
    part = f"partition by {keys} " if keys else ""
    return (f"select * from (select *, cast({function}() over ({part}order by value {direction} "
            f"nulls last{ties}) as bigint) as rank from {EVENTS}) {where}")


RANKS = {
    "rank_row_number": (ranked("row_number", "user_id", "desc", "", ", event_id"),
                        dict(method="row_number", order_by=["event_id"])),
    "rank_min": (ranked("rank", "event_type", "desc"), dict(method="rank")),
    "rank_dense": (ranked("dense_rank", "event_type", "asc"),
                   dict(method="dense_rank", ascending=True)),
}
for _name, (_sql, _options) in RANKS.items():
    _keys = ["user_id"] if "row_number" in _name else ["event_type"]
    query(_name, _sql)(lambda t, k=_keys, o=_options: mr.rank_rows(
        events(t), "value", k, **o).result)
    query(f"{_name}_chunked", _sql)(lambda t, k=_keys, o=_options: mr.rank_rows(
        events(t), "value", k, max_group_rows=0, **o).result)

for _method, _ties in (("row_number", ", event_id"), ("rank", ""), ("dense_rank", "")):
    _order = ["event_id"] if _method == "row_number" else []
    query(f"rank_top_{_method}", ranked(_method, "user_id", "desc", "where rank <= 3", _ties))(
        lambda t, m=_method, o=_order: mr.rank_rows(
            events(t), "value", ["user_id"], method=m, top_n=3, order_by=o).result)
    query(f"rank_global_top_{_method}", ranked(_method, "", "asc", "where rank <= 20", _ties))(
        lambda t, m=_method, o=_order: mr.rank_rows(
            events(t), "value", method=m, top_n=20, ascending=True, order_by=o).result)
    query(f"rank_global_{_method}", ranked(_method, "", "desc", "", _ties))(
        lambda t, m=_method, o=_order: mr.rank_rows(
            events(t), "value", method=m, order_by=o, max_group_rows=0).result)


@query("rank_discard", ranked("row_number", "event_type", "desc", "where rank > 50", ", event_id"))
def rank_discard(t):
    return mr.rank_rows(events(t), "value", ["event_type"], top_n=50, order_by=["event_id"],
                        discard=True).discarded


# Deduplication.
DEDUP = """select o_orderkey, status, o_custkey from (select o_orderkey, status, o_custkey,
    row_number() over (partition by o_custkey, status order by o_orderkey {}) as a,
    count(*) over (partition by o_custkey, status) as n from """ + GAPPY + ") where {}"


def dedup(t: Tables, keep: str):
    return mr.deduplicate(gappy(t).select("o_orderkey", "status", "o_custkey"),
                          ["o_custkey", "status"], keep, ["o_orderkey"])


query("dedup_first", DEDUP.format("asc", "a = 1"))(lambda t: dedup(t, "first").result)
query("dedup_last", DEDUP.format("desc", "a = 1"))(lambda t: dedup(t, "last").result)
query("dedup_none", DEDUP.format("asc", "n = 1"))(lambda t: dedup(t, "none").result)
query("dedup_report", DEDUP.format("asc", "n > 1"))(lambda t: dedup(t, "first").duplicates)


# Join, filter, aggregate, rank.
JFA = """(select o_orderkey, o_custkey, o_totalprice, nullif(c_mktsegment, 'BUILDING')
    as c_mktsegment, c_nationkey from orders join customer on o_custkey = c_custkey
    where o_totalprice > 100000)"""


def jfa(t: Tables, **options):
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                                 F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return mr.join_filter_aggregate(
        t.orders, customer, "o_custkey", where=[("o_totalprice", ">", "100000")],
        left_columns=["o_orderkey", "o_custkey", "o_totalprice"], **options)


SEGMENT = [("o_totalprice", "sum", "total"), ("*", "count", "_row_count"),
           ("o_custkey", "nunique", "customers")]


@query("join_filter_agg", f"""
    select j.*, round(g.total, 2) as total, g.n as _row_count, g.customers
    from {JFA} j left join (select c_mktsegment, sum(o_totalprice) as total, count(*) as n,
        count(distinct o_custkey) as customers from {JFA} where c_mktsegment is not null
        group by 1) g on j.c_mktsegment = g.c_mktsegment""")
def join_filter_agg(t):
    return rounded(jfa(t, group_by=["c_mktsegment"], aggs=SEGMENT), 2, "total")


@query("join_filter_agg_grouped", f"""
    select * from (select c_nationkey, count(*) as _row_count, max(o_totalprice) as top,
        cast(rank() over (order by max(o_totalprice) desc) as bigint) as rank
    from {JFA} group by 1) where rank <= 10""")
def join_filter_agg_grouped(t):
    return jfa(t, group_by=["c_nationkey"], aggs=[("*", "count"), ("o_totalprice", "max", "top")],
               attach=False, rank_by="top", top_n=10)


@query("join_filter_agg_global", f"""
    select j.*, g.* from {JFA} j, (select count(*) as orders, min(o_totalprice) as low,
        count(distinct c_nationkey) as nations, median(o_totalprice) as mid from {JFA}) g""")
def join_filter_agg_global(t):
    return jfa(t, aggs=[("*", "count", "orders"), ("o_totalprice", "min", "low"),
                        ("c_nationkey", "nunique", "nations"), ("o_totalprice", "median", "mid")])


@query("join_filter_agg_count", f"""
    select j.*, g.n as _row_count from {JFA} j left join (select c_mktsegment, count(*) as n
        from {JFA} where c_mktsegment is not null group by 1) g
        on j.c_mktsegment = g.c_mktsegment""")
def join_filter_agg_count(t):
    return jfa(t, group_by=["c_mktsegment"])


TOP = f"""select * from (select *, cast(rank() over (order by best desc nulls last) as bigint)
    as rank from (select o_orderkey, c_nationkey, o_totalprice,
        max(o_totalprice) over (partition by c_nationkey) as best from {JFA})) where rank <= 25"""


@query("join_filter_agg_topn", TOP)
def join_filter_agg_topn(t):
    return jfa(t, group_by=["c_nationkey"], aggs=[("o_totalprice", "max", "best")],
               rank_by="best", top_n=25, drop=["c_mktsegment", "o_custkey"], sort=True,
               order_by=["o_orderkey"], move=("c_nationkey", "o_orderkey"))


@query("chain_cast_agg_rank", f"""
    with typed as (select o_custkey, try_cast(replace('$' || cast(o_totalprice as varchar),
        '$', '') as double) as amount from orders),
    best as (select o_custkey, max(amount) as amount_max, count(amount) as amount_count
        from typed group by 1)
    select * from (select *, cast(dense_rank() over (order by amount_count desc) as integer)
        as rank from best) where rank <= 5""")
def chain_cast_agg_rank(t):
    text = t.orders.select("o_custkey", F.concat(F.lit("$"), F.col("o_totalprice")).alias("amount"))
    return mr.chain(
        text,
        lambda df: mr.cast_types(df, [{"column": "amount", "target_type": "float"}],
                                 strip_currency=True),
        lambda df: mr.aggregate(df, ["o_custkey"], [("amount", "max"), ("amount", "count")]),
        lambda df: mr.rank_rows(df, "amount_count", method="dense_rank", top_n=5))
