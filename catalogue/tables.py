"""Sources and sinks: a table is written in a format to the scratch folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

import millrace as mr
from millrace.sources import delimited
from millrace.sources.archives import member_lines

from .fixtures import (in_hundreds, mixed_folder, raw_lines, text_files, zip_files,
                       zip_orders)
from .registry import Tables, query

ORDERS = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders"""


def orders(t: Tables):
    return t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def written(t: Tables, fmt: str, **options) -> str:
    path = mr.scratch_path(t.spark, fmt)
    mr.write(orders(t), path, fmt, **options)
    return path


def exported(t: Tables, df, fmt: str, **options) -> str:
    path = mr.scratch_path(t.spark, fmt)
    df.write.options(**options).format(fmt).save(path)
    return path


@query("csv_pipe_roundtrip", ORDERS)
def csv_pipe_roundtrip(t):
    path = exported(t, orders(t), "csv", sep="|", header=True)
    return mr.read_delimited(t.spark, path).result


query("csv_quoted_roundtrip", ORDERS)(lambda t: mr.read_any(t.spark, written(
    t, "csv", quote_all=True)))
query("tsv_roundtrip", ORDERS)(lambda t: mr.read_any(t.spark, written(t, "tsv")))
query("parquet_roundtrip", ORDERS)(lambda t: mr.read_any(t.spark, written(t, "parquet")))


@query("csv_all_text", """
    select cast(o_orderkey as varchar) as o_orderkey, '0' || cast(o_custkey as varchar) as code
    from orders""")
def csv_all_text(t):
    text = t.orders.select("o_orderkey", F.concat(F.lit("0"), F.col("o_custkey")).alias("code"))
    path = exported(t, text, "csv", sep=";", header=True)
    return mr.read_delimited(t.spark, path, infer=False).result


@query("csv_legacy_encoding", """
    select o_orderkey, '€ ' || o_orderpriority || ' – é' as label from orders""")
def csv_legacy_encoding(t):
    label = F.concat(F.lit("€ "), F.col("o_orderpriority"), F.lit(" – é"))
    # Written so that the file holds cp1252 bytes.
    raw = t.orders.select("o_orderkey", F.translate(label, delimited.CP1252_TO,
                                                    delimited.CP1252_FROM).alias("label"))
    path = exported(t, raw, "csv", header=True, encoding="ISO-8859-1")
    return mr.read_delimited(t.spark, path).result


@query("csv_quoted_line_breaks", """
    select o_orderkey, o_orderstatus || chr(10) || '"' || o_orderpriority || '", x' as note
    from orders""")
def csv_quoted_line_breaks(t):
    note = F.concat("o_orderstatus", F.lit('\n"'), F.col("o_orderpriority"), F.lit('", x'))
    path = exported(t, t.orders.select("o_orderkey", note.alias("note")), "csv", header=True,
                    escape='"')
    return mr.read_delimited(t.spark, path).result


def ragged(t: Tables):
    """Urgent orders get a field too many, high-priority ones lack the last field."""
    priority = F.col("o_orderpriority")
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(
        priority == "1-URGENT", F.concat(priority, F.lit(",extra"))).when(
        priority != "2-HIGH", priority))
    path = mr.scratch_path(t.spark, "ragged")
    raw_lines(t.orders, "o_orderkey,o_orderstatus,o_orderpriority", line, path)
    return mr.read_delimited(t.spark, path)


@query("csv_bad_lines", """
    select o_orderkey, o_orderstatus, nullif(o_orderpriority, '2-HIGH') as o_orderpriority
    from orders where o_orderpriority <> '1-URGENT'""")
def csv_bad_lines(t):
    return ragged(t).result


@query("csv_bad_lines_report", """
    select cast(o_orderkey as varchar) as o_orderkey from orders
    where o_orderpriority = '1-URGENT'""")
def csv_bad_lines_report(t):
    return ragged(t).bad_lines.select("o_orderkey")


@query("json_nested_flatten", """
    select o_orderkey as "order.key", o_orderstatus as "order.state.code", o_custkey as customer,
        o_orderstatus || '|' || o_orderpriority as marks from orders""")
def json_nested_flatten(t):
    nested = t.orders.select(
        F.struct(F.col("o_orderkey").alias("key"),
                 F.struct(F.col("o_orderstatus").alias("code")).alias("state")).alias("order"),
        F.col("o_custkey").alias("customer"),
        F.array("o_orderstatus", "o_orderpriority").alias("marks"))
    path = exported(t, nested, "json")
    out = mr.read_json(t.spark, path)
    return out.withColumn("marks", F.array_join("marks", "|"))


@query("xml_roundtrip", """
    select cast(o_orderkey as varchar) as key, o_orderstatus as status,
        o_orderpriority as priority from orders""")
def xml_roundtrip(t):
    nested = t.orders.select(F.col("o_orderkey").alias("key"), F.struct(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
        .alias("marks"), F.lit("v").alias("_version"))
    path = exported(t, nested, "xml", rowTag="order", rootTag="orders")
    return mr.read_xml(t.spark, path)


@query("zip_member_scan", ORDERS)
def zip_member_scan(t):
    path = zip_orders(t)
    return mr.read_archive(t.spark, path, "ORDERS.csv")


MONTH = "strftime(o_orderdate, '%Y-%m')"


@query("zip_union", f"""
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority,
        {MONTH} || '.zip' as source_file from orders""")
def zip_union(t):
    return mr.read_archive(t.spark, zip_orders(t), "orders.csv", source_column="source_file")


@query("zip_member_inventory", f"""
    select {MONTH} || '.zip' as archive, unnest(['data/orders.csv', 'priorities.csv']) as member,
        unnest([count(*), count(distinct o_orderpriority)]) as rows from orders group by {MONTH}""")
def zip_member_inventory(t):
    found = mr.members(t.spark, zip_orders(t), skip_extensions=[".sql"])
    return member_lines(found).groupBy("archive", "member").agg(
        (F.count(F.lit(1)) - 1).alias("rows"))


@query("zip_join_members", f"""
    select {MONTH} || '.zip' as archive, cast(o_orderkey as varchar) as o_orderkey,
        o_orderpriority, substring(o_orderpriority, 1, 1) as rank from orders""")
def zip_join_members(t):
    path = zip_orders(t)
    left, right = (mr.read_archive(t.spark, path, m, infer=False, source_column="archive",
                                   skip_extensions=["sql"])
                   for m in ("orders.csv", "Priorities.csv"))
    return mr.join_tables(left, right, ["archive", "o_orderpriority"],
                          suffixes=("_left", "_right"),
                          left_columns=["archive", "o_orderkey", "o_orderpriority"],
                          move=("rank", "o_orderkey"))


query("zip_first_member", ORDERS)(lambda t: mr.read_archive(t.spark, zip_orders(t)))


@query("zip_member_aggregate", f"""
    select {MONTH} || '.zip' as archive, o_orderstatus, count(*) as orders,
        max(o_totalprice) as top from orders group by all""")
def zip_member_aggregate(t):
    rows = mr.read_archive(t.spark, zip_orders(t), "orders.csv", source_column="archive")
    return mr.aggregate(rows, ["archive", "o_orderstatus"], [
        ("*", "count", "orders"), ("o_totalprice", "max", "top")])


@query("zip_every_member", f"""
    select 'orders.csv' as member, count(*) as rows from orders union all
    select 'priorities.csv', count(*) from (
        select distinct {MONTH}, o_orderpriority from orders)""")
def zip_every_member(t):
    return mr.run_summary(mr.archive_tables(t.spark, zip_orders(t))).select(
        F.col("output").alias("member"), "rows")


DOCUMENT = """select o_custkey as doc_id, row_number() over (
    partition by o_custkey order by o_orderkey) as row_no, o_orderkey, o_orderpriority from orders"""


def order_pages(t: Tables):
    """One HTML document per customer, with the customer's orders as a table."""
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey"), F.lit("</td><td><b>"),
                   F.col("o_orderpriority"), F.lit("</b> &amp; more</td></tr>\n"))
    pages = mr.aggregate(t.orders.withColumn("row", row), ["o_custkey"],
                         [("row", "concat", "rows")], order_by=["o_orderkey"])
    html = F.concat(F.lit("<html><body><p>x</p><table><tr><th>key</th><th>label</th></tr>"),
                    F.replace("rows", F.lit("|")), F.lit("</table></body></html>"))
    return pages.select(F.col("o_custkey").alias("doc_id"), html.alias("html"))


@query("html_tables_roundtrip", f"""
    select doc_id, 0 as table_no, cast(row_no as integer) as row_no, col_no,
        case col_no when 0 then cast(o_orderkey as varchar) else o_orderpriority || ' & more' end
        as text from ({DOCUMENT}), (select unnest([0, 1]) as col_no)
    union all select distinct o_custkey, 0, 0, unnest([0, 1]), unnest(['key', 'label']) from orders""")
def html_tables_roundtrip(t):
    return mr.html_cells(order_pages(t), "html", "doc_id")


@query("html_pages_scan", """
    select page_id, 0 as table_no, 0 as row_no,
        cast(page_id as varchar) || '|' || regexp_replace(trim(url), '\\s+', ' ', 'g') as cells
    from pages""")
def html_pages_scan(t):
    """The raw pages, each led by a table of its id and address."""
    table = F.concat(F.lit("<table><tr><td>"), F.col("page_id"), F.lit("</td><td>"),
                     F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</td></tr></table>"))
    pages = t.pages.select("page_id", F.concat(table, "html").alias("html"))
    return mr.html_rows(pages, "html", "page_id").withColumn("cells", F.array_join("cells", "|"))


@query("folder_inventory", """
    select 'csv' as ext, 'c_custkey|c_name|c_acctbal' as columns, count(*) as rows
    from customer
    union all select 'csv', 's_suppkey|s_name', count(*) from supplier
    union all select 'parquet', 'o_orderkey|o_orderstatus', count(*) from orders""")
def folder_inventory(t):
    return mr.folder_inventory(t.spark, mixed_folder(t)).groupBy(
        "ext", F.array_join("columns", "|").alias("columns")).agg(
        F.sum("rows").alias("rows"))


@query("union_folder", """
    select c_custkey, c_name, c_acctbal, null::bigint as s_suppkey, null::varchar as s_name,
        null::bigint as o_orderkey, null::varchar as o_orderstatus, 'csv' as kind from customer
    union all select null, null, null, s_suppkey, s_name, null, null, 'csv' from supplier
    union all select null, null, null, null, null, o_orderkey, o_orderstatus, 'parquet'
    from orders""")
def union_folder(t):
    out = mr.union_folder(t.spark, mixed_folder(t), source_tag="kind")
    return out.withColumn("kind", F.element_at(F.split("kind", "[.]"), -1))


@query("union_folder_schema", """
    select c_custkey as "KEY", c_name as label from customer
    union all select s_suppkey, s_name from supplier
    union all select o_orderkey, o_orderstatus from orders""")
def union_folder_schema(t):
    return mr.union_folder(t.spark, mixed_folder(t), output_columns="KEY, label")


@query("normalise_output", ORDERS)
def normalise_output(t):
    out = mr.scratch_path(t.spark, "normal")
    done = mr.normalise_output(t.spark, written(t, "tsv"), out, "parquet", prefix="clean_")
    return t.spark.read.parquet(done["output"])


CUSTOMERS = "select c_custkey, c_name from customer"
query("json_writer_roundtrip", ORDERS)(lambda t: mr.read_any(t.spark, written(t, "json")))


def customer_json():
    return F.to_json(F.struct("c_custkey", "c_name"))


@query("json_mixed_forms", f"{CUSTOMERS} union all select s_suppkey, s_name from supplier")
def json_mixed_forms(t):
    """Documents that are arrays over several lines beside files of one object a line."""
    path = mr.scratch_path(t.spark, "json")
    text_files(in_hundreds(t.customer, "c_custkey", customer_json(), "c%s.json", "[\n", "\n]", ",\n"),
               path)
    suppliers = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    text_files(in_hundreds(suppliers, "c_custkey", customer_json(), "s%s.json"), path)
    return mr.read_any(t.spark, path).select("c_custkey", "c_name")


@query("union_folder_parquet_schemas", """
    select c_custkey as key, c_name as label, null::double as balance from customer
    union all select s_suppkey, null, s_acctbal from supplier""")
def union_folder_parquet_schemas(t):
    path = mr.scratch_path(t.spark, "parquet")
    t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label")).write.parquet(path)
    t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")).write.mode(
        "append").parquet(path)
    return mr.union_folder(t.spark, path).select("key", "label", "balance")


@query("union_folder_json", f"{CUSTOMERS}")
def union_folder_json(t):
    path = exported(t, t.customer.select("c_custkey", "c_name"), "json")
    return mr.union_folder(t.spark, path)


@query("xml_mixed_children", """
    select cast(c_custkey as varchar) as key, c_name as label, null::varchar as code
    from customer where c_custkey % 2 = 0
    union all select cast(c_custkey as varchar), null, c_mktsegment from customer
    where c_custkey % 2 = 1""")
def xml_mixed_children(t):
    """Records of one document that differ in tag and fields."""
    even = F.col("c_custkey") % 2 == 0
    line = F.concat(F.when(even, "<client><key>").otherwise("<prospect><key>"), "c_custkey",
                    F.when(even, F.concat(F.lit("</key><label>"), "c_name", F.lit("</label></client>")))
                    .otherwise(F.concat(F.lit("</key><code>"), "c_mktsegment",
                                        F.lit("</code></prospect>"))))
    files = in_hundreds(t.customer, "c_custkey", line, "c%s.xml", "<all>\n", "\n</all>")
    path = text_files(files, mr.scratch_path(t.spark, "xml"))
    return mr.read_xml(t.spark, path).select("key", "label", "code")


@query("xml_flat_children", "select cast(c_custkey as varchar) as id from customer")
def xml_flat_children(t):
    line = F.concat(F.lit("<id>"), "c_custkey", F.lit("</id>"))
    files = in_hundreds(t.customer, "c_custkey", line, "c%s.xml", "<ids>", "</ids>")
    return mr.read_xml(t.spark, text_files(files, mr.scratch_path(t.spark, "xml")))


@query("html_files_union", """
    select c_custkey as key, c_name as label, c_mktsegment as segment, null::double as balance
    from customer where c_custkey % 2 = 0
    union all select c_custkey, c_name, c_mktsegment, null from customer where c_custkey % 2 = 1
    union all select s_suppkey, null, null, s_acctbal from supplier""")
def html_files_union(t):
    """Two headers; the segment's cell spans two rows, of customers 2n and 2n + 1."""
    path = mr.scratch_path(t.spark, "html")

    def row(*cells):
        return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))],
                        F.lit("</tr>"))

    def page(df, key, line, name, header):
        head = "".join(f"<th>{h}</th>" for h in header)
        text_files(in_hundreds(df, key, line, name, f"<table><tr>{head}</tr>", "</table>"), path)

    later = t.customer.select((F.col("c_custkey") - 1).alias("c_custkey"),
                              F.col("c_name").alias("name"), F.col("c_mktsegment").alias("mkt"))
    even = t.customer.filter("c_custkey % 2 = 0").join(later, "c_custkey", "left")
    same = F.coalesce(F.col("mkt") == F.col("c_mktsegment"), F.lit(False))
    span = F.concat(F.lit("<tr><td>"), "c_custkey", F.lit("</td><td>"), "c_name",
                    F.when(same, "</td><td rowspan=2>").otherwise("</td><td>"), "c_mktsegment",
                    F.lit("</td></tr>"))
    key = (F.col("c_custkey") + 1).cast("string")
    follow = F.when(same, row(key, F.col("name"))).when(
        F.col("name").isNotNull(), row(key, F.col("name"), F.col("mkt"))).otherwise("")
    page(even, "c_custkey", F.concat(span, follow), "c%s.html", ("key", "label", "segment"))
    alone = t.customer.filter("c_custkey % 2 = 1").join(
        t.customer.select((F.col("c_custkey") + 1).alias("c_custkey")), "c_custkey", "left_anti")
    page(alone, "c_custkey", row("c_custkey", "c_name", "c_mktsegment"), "o%s.html",
         ("key", "label", "segment"))
    page(t.supplier, "s_suppkey", row("s_acctbal", "s_suppkey"), "s%s.html", ("balance", "key"))
    return mr.read_any(t.spark, path).select("key", "label", "segment", "balance")


@query("csv_blank_head", CUSTOMERS)
def csv_blank_head(t):
    line = F.concat_ws(";", "c_custkey", "c_name")
    files = in_hundreds(t.customer, "c_custkey", line, "c%s.csv", "\n \nc_custkey;c_name\n")
    return mr.read_delimited(t.spark, text_files(files, mr.scratch_path(t.spark, "csv"))).result


@query("csv_cp1252_header", """select c_custkey, c_name || ' €' as "Prix €" from customer""")
def csv_cp1252_header(t):
    line = F.concat_ws(";", "c_custkey", F.concat("c_name", F.lit(" €")))
    files = in_hundreds(t.customer, "c_custkey", line, "c%s.csv", "c_custkey;Prix €\n")
    path = text_files(files, mr.scratch_path(t.spark, "csv"), "cp1252")
    return mr.read_delimited(t.spark, path).result.select("c_custkey", "Prix €")


def marked_zips(t: Tables, extra: str) -> str:
    """Customers with an inch mark in every second name, and a bad line in every file."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('5" '), "c_name")).otherwise(
        F.concat(F.lit('"'), "c_name", F.lit(', x"')))
    files = in_hundreds(t.customer, "c_custkey", F.concat_ws(",", "c_custkey", name), "c%s.zip",
                        "c_custkey,c_name\n", extra)
    return zip_files(files.select(F.col("name").alias("archive"), F.lit("c.csv").alias("member"),
                                  "text"), mr.scratch_path(t.spark, "zips"))


@query("zip_stray_quotes", """
    select c_custkey, case when c_custkey % 2 = 0 then '5" ' || c_name else c_name || ', x' end
        as c_name from customer""")
def zip_stray_quotes(t):
    return mr.read_archive(t.spark, marked_zips(t, "\n"), "c.csv")


@query("zip_legacy_encoding", """
    select c_custkey, c_name || case when c_custkey % 7 = 0 then ' caf\u00e9 \u20ac' else '' end as c_name
    from customer""")
def zip_legacy_encoding(t):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 7 == 0, " caf\u00e9 \u20ac").otherwise(""))
    files = in_hundreds(t.customer, "c_custkey", F.concat_ws(",", "c_custkey", name), "c%s.zip",
                        "c_custkey,c_name\n")
    odd = F.regexp_extract("name", r"(\d+)", 1).cast("int") % 2 == 1
    return mr.read_archive(t.spark, zip_files(files.select(
        F.col("name").alias("archive"), F.lit("c.csv").alias("member"), "text",
        F.when(odd, "cp1252").otherwise("utf-8").alias("encoding")), mr.scratch_path(t.spark, "zips")))


def twice_named(t: Tables) -> str:
    path = mr.scratch_path(t.spark, "twice")
    raw_lines(t.customer, "id,name,name,name", F.concat_ws(
        ",", "c_custkey", "c_mktsegment", F.col("c_custkey") + 1, F.lit("x")), path)
    return path


@query("csv_repeated_header", """
    select c_custkey as id, c_mktsegment as name, c_custkey + 1 as "name.1", 'x' as "name.2"
    from customer""")
def csv_repeated_header(t):
    return mr.read_delimited(t.spark, twice_named(t)).result


@query("csv_files_by_name", """
    select c_custkey, c_name from customer where c_custkey // 100 in (0, 2)""")
def csv_files_by_name(t):
    files = in_hundreds(t.customer, "c_custkey", F.concat_ws(",", "c_custkey", "c_name"), "c%s.csv",
                        "c_custkey,c_name\n")
    have = [r["name"] for r in files.where("name in ('c0.csv', 'c2.csv')").select("name").collect()]
    return mr.union_folder(t.spark, text_files(files, mr.scratch_path(t.spark, "named")), have)


@query("cast_errors_written", """
    select 'result' as output, count(*) as rows, 2 as columns from orders union all
    select 'errors', count(*), 5 from orders where o_orderpriority not like '%9%'""")
def cast_errors_written(t):
    out = mr.cast_types(t.orders.select("o_orderkey", "o_orderpriority"), [
        {"column": "o_orderpriority", "target_type": "integer"}], report_columns=["o_orderkey"])
    path = mr.scratch_path(t.spark, "outputs")
    seen = mr.write_outputs({"result": out.result, "errors": out.errors}, path)
    return mr.run_summary({r["output"].rsplit("/", 1)[-1]: t.spark.read.parquet(r["output"])
                           for r in seen})


@query("zip_bad_lines_report", """
    select distinct 'c' || cast(c_custkey // 100 as varchar) || '.zip' as archive,
        'c.csv' as member, '1,2,3' as line from customer""")
def zip_bad_lines_report(t):
    found = mr.members(t.spark, marked_zips(t, "\n1,2,3\n"))
    return mr.archive_bad_lines(found).select("archive", "member", "line")


def two_kinds_of_zips(t: Tables) -> str:
    """Archives of customers and of suppliers: a table, and a JSON member in the first kind."""
    path = mr.scratch_path(t.spark, "zips")
    line = F.concat_ws(",", "c_custkey", "c_name")
    one = in_hundreds(t.customer, "c_custkey", line, "c%s.zip", "key,label\n")
    other = in_hundreds(t.customer, "c_custkey", F.to_json(F.struct(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))), "c%s.zip")
    zip_files(one.select(F.col("name").alias("archive"), F.lit("t.csv").alias("member"), "text")
              .unionByName(other.select(F.col("name").alias("archive"), F.lit("j.json").alias("member"),
                                        "text")), path)
    line = F.concat_ws(";", "s_suppkey", "s_acctbal")
    two = in_hundreds(t.supplier, "s_suppkey", line, "s%s.zip", "key;balance\n")
    zip_files(two.select(F.col("name").alias("archive"), F.lit("t.csv").alias("member"), "text"), path)
    return path


@query("zip_union_headers", """
    select c_custkey as key, c_name as label, null::double as balance from customer
    union all select s_suppkey, null, s_acctbal from supplier""")
def zip_union_headers(t):
    return mr.read_archive(t.spark, two_kinds_of_zips(t), "T.csv").select("key", "label", "balance")


@query("zip_union_members", """
    select c_custkey as key, c_name as label, null::double as balance, null as segment from customer
    union all select s_suppkey, null, s_acctbal, null from supplier
    union all select c_custkey, null, null, c_mktsegment from customer""")
def zip_union_members(t):
    return mr.union_members(t.spark, two_kinds_of_zips(t)).select("key", "label", "balance", "segment")


@query("zip_every_member_rows", """
    select 't.csv' as member, c_custkey as key, c_name as value from customer
    union all select 't.csv', s_suppkey, null from supplier
    union all select 'j.json', c_custkey, c_mktsegment from customer""")
def zip_every_member_rows(t):
    tables = mr.archive_tables(t.spark, two_kinds_of_zips(t))
    return tables["t.csv"].select(F.lit("t.csv").alias("member"), "key", F.col("label").alias("value")
                                  ).unionByName(tables["j.json"].select(
        F.lit("j.json").alias("member"), "key", F.col("segment").alias("value")))


@query("folder_inventory_kinds", """
    select 'json' as ext, 'c_custkey|c_name' as columns, count(*) as rows, null::varchar as error
    from customer
    union all select 'xml', 'id', count(*), null from customer
    union all select 'html', 'id', count(*), null from supplier
    union all select 'xlsx', null, 0, 'unknown kind of file'
    union all select 'csv', 'key|label', count(*), null from customer""")
def folder_inventory_kinds(t):
    """JSON, XML, HTML, a member of an archive, and a file of unknown kind."""
    path = mr.scratch_path(t.spark, "folder")
    text_files(in_hundreds(t.customer, "c_custkey", customer_json(), "c%s.json"), path)
    item = F.concat(F.lit("<id>"), "c_custkey", F.lit("</id>"))
    text_files(in_hundreds(t.customer, "c_custkey", item, "c%s.xml", "<ids>", "</ids>"), path)
    row = F.concat(F.lit("<tr><td>"), "s_suppkey", F.lit("</td></tr>"))
    text_files(in_hundreds(t.supplier, "s_suppkey", row, "s%s.html", "<table><tr><th>id</th></tr>",
                           "</table>"), path)
    text_files(t.region.filter("r_regionkey = 0").select(F.lit("r.xlsx").alias("name"),
                                                         F.col("r_name").alias("text")), path)
    files = in_hundreds(t.customer, "c_custkey", F.concat_ws(",", "c_custkey", "c_name"), "c%s.zip",
                        "key,label\n")
    zip_files(files.select(F.col("name").alias("archive"), F.lit("t.csv").alias("member"), "text"), path)
    return mr.folder_inventory(t.spark, path).groupBy(
        "ext", F.array_join("columns", "|").alias("columns"), "error").agg(F.sum("rows").alias("rows"))


def breaks_in_quotes(t: Tables) -> str:
    """Doubled quotes, line breaks inside quotes and inch marks, in files of a few kilobytes."""
    note = F.concat(F.lit('"'), "c_mktsegment", F.lit('\n""'), "c_name", F.lit('"", x"'))
    line = F.concat_ws(",", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, note).otherwise(
        F.concat("c_name", F.lit(' 5"'))), F.lit('"a,b"'))
    files = in_hundreds(t.customer, "c_custkey", line, "c%s.csv", "c_custkey,note,mark\n")
    return text_files(files, mr.scratch_path(t.spark, "csv"))


@query("csv_quoted_split", """
    select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment || chr(10) || '"' || c_name || '", x'
        else c_name || ' 5"' end as note, 'a,b' as mark from customer""")
def csv_quoted_split(t):
    """Each file is read in byte ranges of 300 bytes, which cut records anywhere."""
    return mr.read_delimited(t.spark, breaks_in_quotes(t), range_bytes=300).result


def pretty(*columns: str):
    """An object over several lines, with brackets and quotes inside its strings."""
    return F.concat(F.lit('{\n  "key": '), F.col(columns[0]), F.lit(',\n  "label": "}{\\\\\\""'),
                    F.lit(',\n  "part": {"name": "'), F.col(columns[1]), F.lit('", "list": [1, {}]}\n}'))


PRETTY = """select c_custkey as key, '}{\\"' as label, c_name as "part.name" from customer"""


@query("json_concatenated_objects", PRETTY)
def json_concatenated_objects(t):
    """Objects one after the other, each over several lines."""
    files = in_hundreds(t.customer, "c_custkey", pretty("c_custkey", "c_name"), "c%s.json")
    path = text_files(files, mr.scratch_path(t.spark, "json"))
    return mr.read_any(t.spark, path).select("key", "label", F.col("`part.name`"))


@query("json_array_split", PRETTY)
def json_array_split(t):
    """Arrays of objects, each file read in byte ranges of 500 bytes."""
    files = in_hundreds(t.customer, "c_custkey", pretty("c_custkey", "c_name"), "c%s.json", "[\n",
                        "\n]", ",\n")
    path = text_files(files, mr.scratch_path(t.spark, "json"))
    out = mr.read_json(t.spark, path, range_bytes=500)
    return out.select("key", "label", F.col("`part.name`"))


@query("read_any_parquet_schemas", """
    select c_custkey as key, c_name as label, null::double as balance from customer
    union all select s_suppkey, null, s_acctbal from supplier""")
def read_any_parquet_schemas(t):
    path = mr.scratch_path(t.spark, "parquet")
    t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label")).write.parquet(path)
    t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")).write.mode(
        "append").parquet(path)
    return mr.read_any(t.spark, path).select("key", "label", "balance")


@query("union_folder_with_archives", """
    select c_custkey as key, c_name as label, null::double as balance, null as segment, 'zip' as kind
    from customer
    union all select s_suppkey, null, s_acctbal, null, 'zip' from supplier
    union all select c_custkey, null, null, c_mktsegment, 'zip' from customer
    union all select o_orderkey, o_orderpriority, o_totalprice, null, 'csv' from orders""")
def union_folder_with_archives(t):
    """Delimited files beside archives of delimited and JSON members."""
    path = two_kinds_of_zips(t)
    line = F.concat_ws(";", "o_orderkey", "o_orderpriority", "o_totalprice")
    text_files(in_hundreds(t.orders, "o_orderkey", line, "o%s.csv", "key;label;balance\n"), path)
    out = mr.union_folder(t.spark, path, source_tag="kind")
    return out.select("key", "label", "balance", "segment", F.element_at(
        F.split("kind", "[.]"), -1).alias("kind"))


@query("zip_open_quote_report", """
    select 'c' || cast(c_custkey // 100 as varchar) || '.zip' as archive, count(*) as rows,
        1 as bad from customer group by 1""")
def zip_open_quote_report(t):
    """A quote that is never closed costs its own line; the lines after it are kept."""
    files = in_hundreds(t.customer, "c_custkey", F.concat_ws(",", "c_custkey", "c_name"), "c%s.zip",
                        'key,label\n0,"abc\n')
    path = zip_files(files.select(F.col("name").alias("archive"), F.lit("c.csv").alias("member"),
                                  "text"), mr.scratch_path(t.spark, "zips"))
    rows = mr.read_archive(t.spark, path, "c.csv", source_column="archive").groupBy("archive").agg(
        F.count("*").alias("rows"))
    bad = mr.archive_bad_lines(mr.members(t.spark, path)).groupBy("archive").agg(
        F.count("*").alias("bad"))
    return rows.join(bad, "archive")


@query("folder_inventory_errors", """
    select 'csv' as ext, count(*) as rows, false as refused from customer
    union all select 'json', count(*), false from supplier
    union all select unnest(['zip', 'parquet', 'xml']), 0, true""")
def folder_inventory_errors(t):
    """A truncated archive, Parquet file and XML document beside sound files and an archive."""
    path = mr.scratch_path(t.spark, "folder")
    text_files(in_hundreds(t.customer, "c_custkey", F.concat_ws(",", "c_custkey", "c_name"), "c%s.csv",
                           "key,label\n"), path)
    inside = in_hundreds(t.supplier, "s_suppkey", F.to_json(F.struct("s_suppkey")), "s%s.zip")
    zip_files(inside.select(F.col("name").alias("archive"), F.lit("s.json").alias("member"), "text"), path)
    text_files(t.region.filter("r_regionkey = 0").select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(x).alias("text")) for n, x in (
            ("z.zip", "PK\x03\x04 cut"), ("p.parquet", "PAR1 cut"), ("x.xml", "<all><r><a>1</a>"))]))), path)
    return mr.folder_inventory(t.spark, path).groupBy(
        "ext", F.col("error").isNotNull().alias("refused")).agg(F.sum("rows").alias("rows"))
