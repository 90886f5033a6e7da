"""Joins, unions and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import millrace as mr

from .registry import Tables, query

# Null-bearing keys: one value on each side becomes null, so nulls meet nulls.
ORDERS = """(select nullif(o_custkey, 7) as custkey, o_orderkey, o_totalprice,
    o_orderstatus as flag from orders)"""
CUSTOMERS = """(select nullif(c_custkey, 11) as custkey, c_name, c_acctbal,
    c_mktsegment as flag from customer)"""
JOINED = f"""select coalesce(l.custkey, r.custkey) as custkey, o_orderkey, o_totalprice,
    l.flag as flag_order, c_name, c_acctbal, r.flag as flag_customer
    from {ORDERS} l {{how}} join {CUSTOMERS} r on l.custkey is not distinct from r.custkey"""
SUFFIXES = ("_order", "_customer")


def keyed_orders(t: Tables) -> DataFrame:
    return t.orders.select(F.nullif("o_custkey", F.lit(7)).alias("custkey"), "o_orderkey",
                           "o_totalprice", F.col("o_orderstatus").alias("flag"))


def keyed_customers(t: Tables) -> DataFrame:
    return t.customer.select(F.nullif("c_custkey", F.lit(11)).alias("custkey"), "c_name",
                             "c_acctbal", F.col("c_mktsegment").alias("flag"))


for _how, _sql in (("inner", "inner"), ("left", "left"), ("right", "right"), ("outer", "full")):
    query(f"join_two_{_how}", JOINED.format(how=_sql))(
        lambda t, how=_how: mr.join_tables(keyed_orders(t), keyed_customers(t), "custkey", how=how,
                                           suffixes=SUFFIXES))

query("join_salted_outer", JOINED.format(how="full"))(
    lambda t: mr.join(keyed_orders(t), keyed_customers(t), "custkey", how="outer",
                      suffixes=SUFFIXES, salt=4))


@query("join_diff_keys", f"""
    select r.c_name, r.c_acctbal, r.custkey as customer, o_orderkey, o_totalprice
    from (select custkey, c_name, c_acctbal from {CUSTOMERS}) r
    full join {ORDERS} l on r.custkey is not distinct from l.custkey""")
def join_diff_keys(t):
    left = mr.rename(keyed_customers(t).drop("flag"), {"custkey": "customer"})
    return mr.join_tables(left, keyed_orders(t).drop("flag"), left_on="customer",
                          right_on="custkey", how="outer")


@query("join_multi_key", """
    select l_orderkey, l_partkey, l_suppkey, l_quantity, p.n as part_lines, p.top as part_top
    from lineitem left join (
        select l_partkey as pk, l_suppkey as sk, count(*) as n, max(l_quantity) as top
        from lineitem where l_returnflag = 'R' group by 1, 2) p
      on l_partkey is not distinct from p.pk and l_suppkey is not distinct from p.sk""")
def join_multi_key(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    returned = mr.aggregate(mr.filter_rows(lines, [("l_returnflag", "==", "R")]),
                            ["l_partkey", "l_suppkey"],
                            [("*", "size", "part_lines"), ("l_quantity", "max", "part_top")])
    returned = mr.rename(returned, {"l_partkey": "pk", "l_suppkey": "sk"})
    return mr.join_tables(lines, returned, left_on=["l_partkey", "l_suppkey"],
                          right_on=["pk", "sk"], how="left", drop=["l_returnflag"])


@query("join_chain", """
    select l_orderkey, l_linenumber, l_extendedprice, o_totalprice, c_name, n_name, r_name
    from lineitem
    join orders on l_orderkey = o_orderkey
    left join customer on o_custkey = c_custkey
    left join nation on c_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey""")
def join_chain(t):
    base = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_linenumber",
                             "l_extendedprice")
    steps = [
        {"table": mr.rename(t.orders, {"o_orderkey": "orderkey", "o_custkey": "custkey",
                                       "o_totalprice": "o_totalprice"}, True),
         "on": "orderkey", "how": "inner"},
        {"table": mr.rename(t.customer, {"c_custkey": "custkey", "c_name": "c_name",
                                         "c_nationkey": "nationkey"}, True), "on": "custkey"},
        {"table": mr.rename(t.nation, {"n_nationkey": "nationkey", "n_regionkey": "regionkey"}),
         "on": "nationkey"},
        {"table": mr.rename(t.region, {"r_regionkey": "regionkey"}), "on": "regionkey"},
    ]
    out = mr.drop_columns(mr.join_chain(base, steps), ["custkey", "nationkey", "regionkey"])
    return mr.rename(out, {"orderkey": "l_orderkey"})


@query("denormalize", f"""
    select r.custkey, r.c_name, o_orderkey as ord_o_orderkey, o_totalprice as ord_o_totalprice,
        l.flag as ord_flag
    from {CUSTOMERS} r left join {ORDERS} l on r.custkey is not distinct from l.custkey""")
def denormalize(t):
    return mr.denormalize(keyed_customers(t), keyed_orders(t), "custkey", how="left",
                          prefix="ord_", header_columns=["custkey", "c_name"])


for _keep, _dir in (("first", "asc"), ("last", "desc")):
    query(f"join_dedup_right_{_keep}", f"""
        select c_custkey as custkey, c_name, o_orderkey, o_totalprice from customer left join (
            select * from orders
            qualify row_number() over (partition by o_custkey order by o_orderkey {_dir}) = 1) o
        on c_custkey is not distinct from o_custkey""")(
        lambda t, keep=_keep: mr.join_tables(
            mr.rename(t.customer, {"c_custkey": "custkey", "c_name": "c_name"}, True),
            mr.rename(t.orders, {"o_custkey": "custkey"}), "custkey", how="left",
            right_columns=["custkey", "o_orderkey", "o_totalprice"],
            dedup_right_by="custkey", dedup_keep=keep, dedup_order=["o_orderkey"]))

# Two snapshots of orders: prices of urgent orders moved, one class is new, one deleted.
CURRENT = """(select o_orderkey, nullif(o_custkey, 7) as o_custkey, o_orderstatus,
    case when o_orderpriority = '1-URGENT' then o_totalprice + 1 else o_totalprice end
    as o_totalprice from orders where o_orderpriority <> '5-LOW')"""
BASELINE = """(select o_orderkey, nullif(o_custkey, 7) as o_custkey, o_orderstatus, o_totalprice
    from orders where o_orderstatus <> 'P')"""
NEW = f"""select c.*, 'NEW' as delta_status from {CURRENT} c
    where not exists (select 1 from {BASELINE} b where b.o_orderkey = c.o_orderkey)"""
CHANGED = f"""select c.*, 'CHANGED' as delta_status from {CURRENT} c join {BASELINE} b
    on b.o_orderkey = c.o_orderkey where b.o_custkey is distinct from c.o_custkey
    or b.o_orderstatus is distinct from c.o_orderstatus
    or b.o_totalprice is distinct from c.o_totalprice"""
DELETED = f"""select b.*, 'DELETED' as delta_status from {BASELINE} b
    where not exists (select 1 from {CURRENT} c where b.o_orderkey = c.o_orderkey)"""


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.orders.withColumn("o_custkey", F.nullif("o_custkey", F.lit(7)))
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1)
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    current = (rows.filter("o_orderpriority <> '5-LOW'")
               .withColumn("o_totalprice", F.coalesce(price, "o_totalprice")).select(columns))
    return current, rows.filter("o_orderstatus <> 'P'").select(columns)


for _mode, _sql in (("full_delta", f"{NEW} union all {CHANGED} union all {DELETED}"),
                    ("new_only", NEW), ("changed_only", CHANGED)):
    query(f"delta_{_mode}", _sql)(
        lambda t, mode=_mode: mr.delta(*snapshots(t), ["o_orderkey"], mode=mode))


@query("delta_type_conflict", """
    select cast(o_orderkey as varchar) as key, o_orderstatus as mark, 'CHANGED' as delta_status
    from orders where o_orderstatus = 'P'
    union all select cast(o_orderkey as varchar) || '-x', o_orderstatus, 'NEW' from orders
    union all select cast(o_orderkey as varchar), o_orderstatus, 'DELETED' from orders
    where o_orderstatus = 'F'""")
def delta_type_conflict(t):
    """Keys are text in one snapshot and whole numbers in the other."""
    text = t.orders.select(F.col("o_orderkey").cast("string").alias("key"),
                           F.col("o_orderstatus").alias("mark"))
    new = text.withColumn("key", F.concat("key", F.lit("-x")))
    current = text.filter("mark <> 'F'").unionAll(new)
    mark = F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus"))
    baseline = t.orders.select(F.col("o_orderkey").alias("key"), mark.alias("mark"))
    return mr.delta(current, baseline, ["key"])


@query("delta_repeated_keys", f"""
    with c as (select o_custkey as k, o_orderstatus as s, o_orderkey from {CURRENT}),
         b as (select o_custkey as k, o_orderstatus as s, o_orderkey from {BASELINE})
    select c.*, 'NEW' as delta_status from c
    where not exists (select 1 from b where b.k is not distinct from c.k)
    union all
    select c.*, 'CHANGED' as delta_status from c where exists (
        select 1 from b join c c2 on b.k is not distinct from c2.k
        where b.s <> c2.s and c2.k is not distinct from c.k)
    union all
    select b.*, 'DELETED' as delta_status from b
    where not exists (select 1 from c where b.k is not distinct from c.k)""")
def delta_repeated_keys(t):
    names = {"o_custkey": "k", "o_orderstatus": "s", "o_orderkey": "o_orderkey"}
    current, baseline = (mr.rename(s, names, True) for s in snapshots(t))
    return mr.delta(current, baseline, ["k"], compare=["s"])


# A cell that becomes null while its neighbour gets its value is a change.
SHIFTED = """select o_orderkey as k, case when o_orderkey % 3 = {r} then o_orderstatus end as a,
    case when o_orderkey % 3 <> {r} then o_orderstatus end as b from orders
    where o_orderkey % 7 <> {r}"""


@query("delta_null_moves", f"""
    with c as ({SHIFTED.format(r=1)}), b as ({SHIFTED.format(r=2)})
    select c.*, case when b.k is null then 'NEW' else 'CHANGED' end as delta_status
    from c left join b on c.k = b.k
    where b.k is null or c.a is distinct from b.a or c.b is distinct from b.b
    union all select b.*, 'DELETED' from b where k not in (select k from c)""")
def delta_null_moves(t):
    def side(r):
        moved, status = F.col("o_orderkey") % 3 == r, F.col("o_orderstatus")
        return t.orders.where(F.col("o_orderkey") % 7 != r).select(
            F.col("o_orderkey").alias("k"), F.when(moved, status).alias("a"),
            F.when(~moved, status).alias("b"))

    return mr.delta(side(1), side(2), ["k"])


# Unions: customers and suppliers share some columns under common names.
PARTIES = """select c_custkey as key, c_name as name, c_acctbal as acctbal,
    c_mktsegment as segment, cast(null as integer) as nation, {a} from customer union all
    select s_suppkey, s_name, s_acctbal, null, s_nationkey, {b} from supplier"""


def parties(t: Tables) -> dict[str, DataFrame]:
    return {
        "customer": mr.rename(t.customer, {"c_custkey": "key", "c_name": "name",
                                           "c_acctbal": "acctbal", "c_mktsegment": "segment"}, True),
        "supplier": mr.rename(t.supplier, {"s_suppkey": "key", "s_name": "name",
                                           "s_acctbal": "acctbal", "s_nationkey": "nation"}, True),
    }


@query("union_by_name", "select key, name, acctbal, segment, nation from ("
       + PARTIES.format(a="1 as x", b="1") + ")")
def union_by_name(t):
    return mr.union(parties(t))


@query("union_source_tag", PARTIES.format(a="'customer' as source_file", b="'supplier'"))
def union_source_tag(t):
    return mr.union(parties(t), source_tag="source_file")


@query("union_type_conflict", """
    select c_custkey as key, cast(c_acctbal as varchar) as info from customer union all
    select s_suppkey, s_name from supplier""")
def union_type_conflict(t):
    return mr.union([mr.rename(t.customer, {"c_custkey": "key", "c_acctbal": "info"}, True),
                     mr.rename(t.supplier, {"s_suppkey": "key", "s_name": "info"}, True)])


@query("union_schema", """
    select c_name as "Name", c_custkey as "KEY", cast(null as varchar) as city from customer
    union all select s_name, s_suppkey, null from supplier""")
def union_schema(t):
    return mr.union(parties(t), output_columns="Name,KEY,city")


@query("union_positional", """
    select n_nationkey as id, n_name as label from nation
    union all select r_regionkey, r_name from region
    union all select o_orderkey, o_orderstatus from orders""")
def union_positional(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return mr.union([t.nation, t.region, orders], output_columns='["id", "label"]')
