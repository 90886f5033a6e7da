"""Filters, routing and column-level reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

import millrace as mr
from millrace import routing

from .registry import Tables, query

STATUS = """(select o_orderkey, o_custkey, o_totalprice, o_orderpriority,
    nullif(o_orderstatus, 'P') as status from orders)"""


def statuses(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                           F.nullif("o_orderstatus", F.lit("P")).alias("status"))


@query("filter_where_builder", f"""
    select * from {STATUS} where coalesce(regexp_matches(o_orderpriority, 'URG|HIGH'), false)
        and o_totalprice >= 150000.5 or starts_with(o_orderpriority, '5')
        and status in ('F', 'X') or o_custkey < 20""")
def filter_where_builder(t):
    return mr.filter_rows(statuses(t), [
        ("o_orderpriority", "contains", "URG|HIGH"), ("o_totalprice", ">=", "150000.5"),
        ("o_orderpriority", "startswith", "5", "or"), ("status", "in", "F, X", "and"),
        ("o_custkey", "<", "20", "or")])


@query("filter_not_equal_nulls", f"select * from {STATUS} where status is distinct from 'F'")
def filter_not_equal_nulls(t):
    return mr.filter_rows(statuses(t), [("status", "!=", "F")])


@query("filter_sql_text", f"select * from {STATUS} where o_totalprice * 2 > 500000 and status = 'O'")
def filter_sql_text(t):
    return mr.filter_rows(statuses(t), "o_totalprice * 2 > 500000 and status = 'O'")


@query("route_rules_multi", f"""
    select *, 'big' as _route from {STATUS} where o_totalprice > 300000 union all
    select *, 'urgent' from {STATUS} where o_orderpriority = '1-URGENT' union all
    select *, 'open' from {STATUS} where status = 'O' union all
    select *, 'unmatched' from {STATUS} where not (o_totalprice > 300000)
        and o_orderpriority <> '1-URGENT' and status is distinct from 'O'""")
def route_rules_multi(t):
    return routing.by_rules(statuses(t), {
        "big": [("o_totalprice", ">", "300000")], "urgent": "o_orderpriority = '1-URGENT'",
        "open": F.col("status") == "O"})


@query("route_values_first_match", f"""
    select *, case when status = 'O' then 'open' when status = 'F' then 'done'
        else 'others' end as _route from {STATUS}""")
def route_values_first_match(t):
    return routing.by_values(statuses(t), "status", {"open": [" o "], "done": ["F", "O"]})


@query("route_values_numeric", """
    select *, case when p_size in (1, 2, 3) then 'small' when p_size in (48, 49, 50) then 'large'
        end as _route from part where p_size in (1, 2, 3, 48, 49, 50)""")
def route_values_numeric(t):
    return routing.by_values(t.part, "p_size", {"small": [1, 2, 3], "large": "48, 49, 50"},
                             others=None, case_sensitive=True)


GROUPS = {"first": "1-urgent, 2-high", "middle": ["3-MEDIUM"]}
PRIORITY = """(select o_orderkey, o_totalprice,
    nullif(o_orderpriority, '5-LOW') as priority from orders)"""
SPLIT = """select * from (select o_orderkey, o_totalprice, priority, case
    when priority is null then {null} when priority in ('1-URGENT', '2-HIGH') then 'first'
    when priority = '3-MEDIUM' then 'middle' else {rest} end as _route from """ + PRIORITY + """)
    where _route is not null"""


def priorities(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice",
                           F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))


query("column_split_null_separate", SPLIT.format(null="'null'", rest="'remaining'"))(
    lambda t: routing.by_groups(priorities(t), "priority", GROUPS))
query("column_split_null_merge", SPLIT.format(null="'remaining'", rest="'remaining'"))(
    lambda t: routing.by_groups(priorities(t), "priority", GROUPS, nulls="merge_into_remaining"))
query("column_split_discard", SPLIT.format(null="null", rest="null").replace(
    "select * from (", "select * exclude (priority) from (", 1))(
    lambda t: routing.by_groups(priorities(t), "priority", GROUPS, nulls="discard",
                                remaining="discard", include_column=False))


@query("split_by_value", """
    select o_orderkey, coalesce('status_' || replace(replace(mark, ' ', '_'), '/', '_') || '.x',
        'mark_NULL') as _route
    from (select o_orderkey, case when o_orderstatus <> 'P'
        then o_orderstatus || ' / ' || o_orderpriority end as mark from orders)""")
def split_by_value(t):
    mark = F.when(F.col("o_orderstatus") != "P",
                  F.concat_ws(" / ", "o_orderstatus", "o_orderpriority"))
    return routing.by_distinct(t.orders.select("o_orderkey", mark.alias("mark")), "mark",
                               template="status_{value}.x", include_column=False)


@query("split_by_value_written", """
    select coalesce(nullif(event_type, 'error'), 'event_type_NULL') as _route,
        count(*) as rows, round(sum(value), 2) as total from events group by 1""")
def split_by_value_written(t):
    path = mr.scratch_path(t.spark, "routes")
    events = t.events.select("event_id", "value",
                             F.nullif("event_type", F.lit("error")).alias("event_type"))
    folders = routing.write_routes(routing.by_distinct(events, "event_type"), path)
    return t.spark.read.parquet(folders[0]).groupBy("_route").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


SPLITS = {"amounts": ["l_quantity", "l_extendedprice", "no_such"], "dates": ["l_shipdate"]}
query("split_columns_amounts", """
    select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem""")(
    lambda t: mr.split_columns(t.lineitem, ["l_orderkey", "l_linenumber"], SPLITS)["amounts"])
query("split_columns_dates", "select l_orderkey, l_linenumber, l_shipdate from lineitem")(
    lambda t: mr.split_columns(t.lineitem, ["l_orderkey", "l_linenumber"], SPLITS)["dates"])


@query("rename_keep", """
    select p_partkey as id, p_name as "part name", p_brand, p_type, p_size, p_retailprice
    from part""")
def rename_keep(t):
    return mr.rename(t.part, {"p_partkey": "id", "p_name": "part name", "gone": "x"})


@query("rename_drop_unmapped", "select p_name as label, p_partkey as id from part")
def rename_drop_unmapped(t):
    return mr.rename(t.part, {"p_name": "label", "p_partkey": "id", "gone": "x"}, True)


@query("move_column", "select c_custkey, c_acctbal, c_name, c_nationkey from customer")
def move_column(t):
    return mr.move_after(mr.drop_columns(t.customer, ["c_mktsegment", "gone"]), "c_acctbal",
                         "c_custkey")


@query("preview_rows", """
    select doc_id, substring(text, 1, 120) as text from documents order by doc_id limit 25""")
def preview_rows(t):
    return mr.preview(t.documents.select("doc_id", "text").orderBy("doc_id"))
