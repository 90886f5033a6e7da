"""Null handling, casting, profiles and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

import millrace as mr

from .registry import Tables, query

HOLES = """(select o_orderkey, nullif(o_orderstatus, 'P') as status,
    case when o_orderpriority in ('1-URGENT', '5-LOW') then null else o_totalprice end as price,
    case when o_orderpriority <> '3-MEDIUM' then o_custkey end as cust,
    nullif(o_orderpriority, '2-HIGH') as priority from orders)"""


def holes(t: Tables):
    priority = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(~priority.isin("1-URGENT", "5-LOW"), F.col("o_totalprice")).alias("price"),
        F.when(priority != "3-MEDIUM", F.col("o_custkey")).alias("cust"),
        F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("priority"))


def cleaned(t: Tables, *rules, **options):
    return mr.handle_nulls(holes(t), [
        dict(zip(("column", "strategy", "fill_value"), r)) for r in rules], **options).result


def rounded(df, name, digits=4):
    return df.withColumn(name, F.round(F.col(name), digits))


query("nulls_fill", f"""
    select o_orderkey, coalesce(status, 'UNKNOWN') as status, coalesce(price, 0) as price,
        coalesce(cust, -1) as cust, priority from {HOLES}""")(
    lambda t: cleaned(t, ("status", "fill", "UNKNOWN"), ("price", "fill", "0"),
                      ("cust", "fill", "-1"), ("gone", "fill", "x")))
query("nulls_fill_tokens", """
    select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') as status,
        coalesce(case when o_orderpriority not in ('1-URGENT', '5-LOW') then o_orderpriority end,
        '?') as priority from orders""")(
    lambda t: mr.handle_nulls(
        t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"),
                        F.col("o_orderpriority").alias("priority")),
        [{"column": c, "strategy": "fill", "fill_value": "?"} for c in ("status", "priority")],
        null_tokens=["P", "1-URGENT", "5-LOW"]).result)
query("nulls_mean", f"""
    select o_orderkey, status, round(coalesce(price, (select avg(price) from {HOLES})), 4) as price,
        cust, priority from {HOLES}""")(
    lambda t: rounded(cleaned(t, ("price", "mean")), "price"))
MEDIAN = f"""select o_orderkey, status,
    round(coalesce(price, (select median(price) from {HOLES})), 4) as price, cust, priority
    from {HOLES}"""
query("nulls_median", MEDIAN)(lambda t: rounded(cleaned(t, ("price", "median")), "price"))
query("nulls_median_chunked", MEDIAN)(
    lambda t: rounded(cleaned(t, ("price", "median"), max_group_rows=0), "price"))
query("nulls_mode", f"""
    select o_orderkey, coalesce(status, (select status from {HOLES} where status is not null
        group by 1 order by count(*) desc, 1 limit 1)) as status, price, cust,
        coalesce(priority, (select priority from {HOLES} where priority is not null
        group by 1 order by count(*) desc, 1 limit 1)) as priority from {HOLES}""")(
    lambda t: cleaned(t, ("status", "mode"), ("priority", "mode")))

FFILL = f"""select o_orderkey,
    coalesce(status, last_value(status ignore nulls) over w) as status,
    coalesce(price, last_value(price ignore nulls) over w) as price, cust, priority
    from {HOLES} window w as (order by o_orderkey rows between unbounded preceding and current row)"""
BFILL = FFILL.replace("order by o_orderkey rows", "order by o_orderkey desc rows")
for _name, _strategy, _sql in (("ffill", "forward_fill", FFILL), ("bfill", "backward_fill", BFILL)):
    for _suffix, _options in (("", {}), ("_chunked", {"max_group_rows": 0})):
        query(f"nulls_{_name}{_suffix}", _sql)(lambda t, s=_strategy, o=_options: cleaned(
            t, ("status", s), ("price", s), order_by=["o_orderkey"], **o))

# One row has no order key: it comes first, and so gives its value to the rows after it.
KEYLESS = f"""(select * replace (nullif(o_orderkey, (select max(o_orderkey) from {HOLES}
    where status is not null and price is not null)) as o_orderkey) from {HOLES})"""


def keyless(t: Tables):
    rows = holes(t)
    last = rows.filter("status is not null and price is not null").agg(F.max("o_orderkey")).scalar()
    return rows.withColumn("o_orderkey", F.nullif("o_orderkey", last))


for _name, _strategy, _order in (("ffill", "forward_fill", "o_orderkey nulls first"),
                                 ("bfill", "backward_fill", "o_orderkey desc nulls last")):
    for _suffix, _options in (("", {}), ("_chunked", {"max_group_rows": 0})):
        query(f"nulls_{_name}_null_order{_suffix}", FFILL.replace(
            "order by o_orderkey", f"order by {_order}").replace(HOLES, KEYLESS))(
            lambda t, s=_strategy, o=_options: mr.handle_nulls(keyless(t), [
                {"column": c, "strategy": s} for c in ("status", "price")],
                order_by=["o_orderkey"], **o).result)

query("nulls_drop", f"select * from {HOLES} where status is not null and cust is not null")(
    lambda t: cleaned(t, ("status", "drop_row"), ("cust", "drop_row")))
query("nulls_drop_any_then_mean", f"""
    with kept as (select * from {HOLES} where status is not null)
    select o_orderkey, status, round(coalesce(price, (select avg(price) from kept)), 4) as price,
        cust, priority from kept""")(
    lambda t: rounded(cleaned(t, ("status", "drop_row"), ("price", "mean")), "price"))

query("null_audit", " union all ".join(f"""
    select '{c}' as "Column", count(*) - count({c}) as "Null_Count", count(*) as "Total_Rows",
        round((count(*) - count({c})) / count(*) * 100, 2) as "Null_Pct" from {HOLES}"""
    for c in ("status", "price", "cust", "priority")))(
    lambda t: mr.handle_nulls(holes(t), []).audit)

# Casting: texts derived from orders, some of them unreadable as the target.
RAW = """(select o_orderkey,
    case o_orderpriority when '1-URGENT' then 'n/k' when '5-LOW' then ' '
        when '2-HIGH' then null else '$ ' || cast(o_totalprice as varchar) end as amount,
    case o_orderstatus when 'P' then 'x' || cast(o_custkey as varchar)
        else cast(o_custkey as varchar) || '.0' end as cust,
    case o_orderpriority when '1-URGENT' then ' YES' when '2-HIGH' then 'no'
        when '3-MEDIUM' then 'T' when '5-LOW' then 'maybe' end as flag,
    case o_orderstatus when 'F' then strftime(o_orderdate, '%d/%m/%Y')
        else strftime(o_orderdate, '%Y-%m-%d') end as day from orders)"""


def raw(t: Tables):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    amount = (F.when(priority == "1-URGENT", "n/k").when(priority == "5-LOW", " ")
              .when(priority != "2-HIGH", F.concat(F.lit("$ "), F.col("o_totalprice"))))
    cust = (F.when(status == "P", F.concat(F.lit("x"), F.col("o_custkey")))
            .otherwise(F.concat(F.col("o_custkey"), F.lit(".0"))))
    flag = (F.when(priority == "1-URGENT", " YES").when(priority == "2-HIGH", "no")
            .when(priority == "3-MEDIUM", "T").when(priority == "5-LOW", "maybe"))
    day = F.when(status == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", amount.alias("amount"), cust.alias("cust"),
                           flag.alias("flag"), day.alias("day"))


AMOUNT = {"column": "amount", "target_type": "float"}
CUST = {"column": "cust", "target_type": "integer"}
FLAG = {"column": "flag", "target_type": "boolean"}
DAY = {"column": "day", "target_type": "date", "format": "%d/%m/%Y"}
AMOUNT_SQL = "try_cast(replace(replace(amount, '$', ''), ' ', '') as double)"
CUST_SQL = "try_cast(case when cust not like 'x%' then cust end as double)::bigint"
FLAG_SQL = """case when lower(trim(flag)) in ('yes', 't') then true
    when lower(trim(flag)) = 'no' then false end"""
DAY_SQL = "try_strptime(day, '%d/%m/%Y')"
CAST_SQL = f"""(select *, {AMOUNT_SQL} as a, {CUST_SQL} as c, {FLAG_SQL} as f, {DAY_SQL} as d
    from {RAW})"""


def cast(t: Tables, *rules, **options):
    return mr.cast_types(raw(t), rules, strip_currency=True, report_columns=["o_orderkey"],
                         **options)


query("cast_nullify", f"""
    select o_orderkey, a as amount, c as cust, f as flag, d as day from {CAST_SQL}""")(
    lambda t: cast(t, AMOUNT, CUST, FLAG, DAY).result)
query("cast_keep", f"""
    select o_orderkey, amount, case when c is null then cust else cast(c as varchar) end as cust,
        flag, day from {CAST_SQL}""")(
    lambda t: cast(t, CUST, on_error="keep_original").result)
query("cast_drop", f"""
    select o_orderkey, a as amount, c as cust, flag, day from {CAST_SQL}
    where not (a is null and trim(amount) <> '' and amount is not null) and c is not null""")(
    lambda t: cast(t, AMOUNT, CUST, on_error="drop_row").result)
query("cast_date", f"select o_orderkey, amount, cust, flag, d as day from {CAST_SQL}")(
    lambda t: cast(t, DAY).result)
query("cast_bool", f"select o_orderkey, amount, cust, f as flag, day from {CAST_SQL}")(
    lambda t: cast(t, FLAG).result)
query("cast_text_trim", f"""
    select o_orderkey, trim(amount) as amount, cust, trim(flag) as flag, day from {RAW}""")(
    lambda t: mr.cast_types(raw(t), [], trim_strings=True).result)

ERRORS = {
    "amount": ("amount", "a is null and trim(amount) <> ''", "float", "cast_failed"),
    "cust": ("cust", "c is null", "integer", "cast_failed"),
    "flag": ("flag", "f is null and flag is not null", "boolean", "cast_failed"),
    "day": ("day", "d is null", "date", "cast_failed (expected format: %d/%m/%Y)"),
}
query("cast_errors", " union all ".join(f"""
    select o_orderkey, '{c}' as "column", {c} as original_value, '{kind}' as target_type,
        '{text}' as error from {CAST_SQL} where {failed}"""
    for c, failed, kind, text in ERRORS.values()))(
    lambda t: cast(t, AMOUNT, CUST, FLAG, DAY).errors)

PROFILED = {"o_orderkey": "bigint", "status": "string", "price": "double", "cust": "bigint",
            "priority": "string"}


def profile_sql(c: str, kind: str) -> str:
    return f"""select '{c}' as "column", '{kind}' as type, count({c}) as non_null,
        round((count(*) - count({c})) / count(*) * 100, 1) as null_pct,
        count(distinct {c}) as "unique", cast(min({c}) as varchar) as min,
        cast(max({c}) as varchar) as max, (select cast({c} as varchar) from {HOLES}
        where {c} is not null group by 1 order by count(*) desc, 1 limit 1) as top_value
        from {HOLES}"""


query("profile_columns", " union all ".join(profile_sql(c, k) for c, k in PROFILED.items()))(
    lambda t: mr.profile(holes(t)))
query("profile_top_values", " union all ".join(f"""
    select '{c}' as "column", first(v order by n desc, v) as top_value, max(n) as top_count from (
        select cast({c} as varchar) as v, count(*) as n from orders group by 1)"""
    for c in ("o_orderstatus", "o_orderpriority")) + """
    union all select 'o_orderkey', null, null from orders having count(*) = count(distinct o_orderkey)""")(
    # A column of unique values has no top value that could be proven.
    lambda t: mr.top_values(t.orders.select("o_orderstatus", "o_orderpriority", "o_orderkey")))
query("profile_nested", """
    select 'o_orderkey' as "column", 'bigint' as type, count(*) as non_null, 0.0 as null_pct,
        count(distinct o_orderkey) as "unique", cast(min(o_orderkey) as varchar) as min,
        cast(max(o_orderkey) as varchar) as max, cast(min(o_orderkey) as varchar) as top_value
    from orders union all
    select 'parts', 'array<string>', count(*) filter (o_orderstatus <> 'F'),
        round(count(*) filter (o_orderstatus = 'F') * 100 / count(*), 1), null, null, null, null
    from orders""")(
    lambda t: mr.profile(t.orders.select("o_orderkey", F.when(
        F.col("o_orderstatus") != "F", F.split("o_orderpriority", "-")).alias("parts"))))
query("nulls_fill_every_column", f"""
    select o_orderkey, coalesce(status, '0') as status, coalesce(price, 0) as price,
        coalesce(cust, 0) as cust, coalesce(priority, '0') as priority from {HOLES}""")(
    lambda t: cleaned(t, ("*", "fill", "0")))
query("value_counts", f"""
    select 'status' as "column", status as value, count(*) as count from {HOLES}
    where status is not null group by 2 union all
    select 'priority', priority, count(*) from {HOLES} where priority is not null group by 2""")(
    lambda t: mr.value_counts(holes(t), ["status", "priority"]))
query("run_summary", """
    select 'orders' as output, count(*) as rows, 6 as columns from orders union all
    select 'lineitem', count(*), 11 from lineitem""")(
    lambda t: mr.run_summary({"orders": t.orders, "lineitem": t.lineitem}))
