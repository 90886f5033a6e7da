"""Small end-to-end cases with results worked out by hand."""

from collections import Counter

from helpers import frame, norm, rows

import millrace as mr
from millrace import routing


def test_union_of_two_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount\n1,10\n2,20\n3,30\n")
    (tmp_path / "b.csv").write_text("id,amount\n4,40\n5,50\n")
    out = mr.union_folder(spark, str(tmp_path), source_tag="src")
    assert Counter(r["src"] for r in out.collect()) == {"a.csv": 3, "b.csv": 2}


def test_inner_join(spark):
    customers = frame(spark, "cust_id int, name string", [(1, "a"), (2, "b"), (3, "c")])
    orders = frame(spark, "cust_id int, order_id int, total double",
                   [(1, 10, 5.0), (1, 11, 6.0), (2, 12, 7.0)])
    assert mr.join_tables(customers, orders, "cust_id").count() == 3


def test_chain_of_left_joins(spark):
    base = frame(spark, "pid int, product string", [(1, "a"), (2, "b"), (3, "c")])
    prices = frame(spark, "pid int, price double", [(1, 1.0), (2, 2.0), (4, 4.0)])
    stock = frame(spark, "pid int, qty int", [(1, 7), (3, 9)])
    out = mr.join_chain(base, [{"table": prices, "on": "pid"}, {"table": stock, "on": ["pid"]}])
    assert rows(out) == norm([(1, "a", 1.0, 7), (2, "b", 2.0, None), (3, "c", None, 9)])


def test_deduplicate_keeps_three(spark):
    df = frame(spark, "id int, name string, amount int",
               [(1, "a", 1), (1, "b", 2), (2, "c", 3), (3, "d", 4), (3, "e", 5)])
    out = mr.deduplicate(df, ["id"], "first", ["amount"])
    assert rows(out.result, "name") == [("a",), ("c",), ("d",)]
    assert out.duplicates.count() == 4


def test_best_seller_per_region(spark):
    df = frame(spark, "region string, person string, amount int",
               [("N", "a", 5), ("N", "b", 9), ("S", "c", 3), ("S", "d", 8), ("S", "e", 1)])
    out = mr.rank_rows(df, "amount", ["region"], top_n=1, order_by=["person"])
    assert rows(out.result, "person") == [("b",), ("d",)]


def test_routes(spark):
    df = frame(spark, "id int, status string",
               [(1, "PAID"), (2, "PAID"), (3, "OPEN"), (4, "PENDING"), (5, "VOID")])

    def sizes(routed):
        return Counter(r["_route"] for r in routed.collect())

    assert sizes(routing.by_distinct(df, "status")) == {"PAID": 2, "OPEN": 1, "PENDING": 1, "VOID": 1}
    assert sizes(routing.by_rules(df, {"paid": "status = 'PAID'", "open": "status = 'OPEN'"})) == {
        "paid": 2, "open": 1, "unmatched": 2}
    assert sizes(routing.by_values(df, "status", {"paid": ["PAID"], "due": "OPEN,PENDING"})) == {
        "paid": 2, "due": 2, "others": 1}


def test_delta_statuses(spark):
    current = frame(spark, "id int, amount int", [(1, 10), (2, 25), (4, 40)])
    baseline = frame(spark, "id int, amount int", [(1, 10), (2, 20), (3, 30)])
    assert rows(mr.delta(current, baseline, ["id"]), "id", "delta_status") == norm(
        [(2, "CHANGED"), (3, "DELETED"), (4, "NEW")])


def test_attached_counts(spark):
    """Five accounts with two invoices and five with one: 15 rows that carry their count."""
    accounts = frame(spark, "account string, company string",
                     [(f"C{i}", f"Company {i}") for i in range(10)])
    invoices = frame(spark, "account string, invoice int",
                     [(f"C{i}", 10 * i + j) for i in range(10) for j in range(2 if i < 5 else 1)])
    out = mr.join_filter_aggregate(accounts, invoices, "account", group_by=["account"])
    assert out.columns == ["account", "company", "invoice", "_row_count"]
    assert Counter((r["account"], r["_row_count"]) for r in out.collect()) == {
        **{(f"C{i}", 2): 2 for i in range(5)}, **{(f"C{i}", 1): 1 for i in range(5, 10)}}


def test_filter_before_aggregating(spark):
    orders = frame(spark, "cust_id int, order_id int, amount int",
                   [(1, 1, 150), (1, 2, 250), (2, 3, 300), (2, 4, 120), (3, 5, 500)])
    customers = frame(spark, "cust_id int, region string", [(1, "N"), (2, "N"), (3, "S")])
    options = dict(where=[("amount", ">", "100")], group_by=["region"],
                   aggs=[("amount", "sum", "total"), ("*", "count", "n")])
    assert mr.join_filter_aggregate(orders, customers, "cust_id", **options).count() == 5
    grouped = mr.join_filter_aggregate(orders, customers, "cust_id", attach=False, **options)
    assert rows(grouped) == norm([("N", 820, 4), ("S", 500, 1)])
