"""Casting, predicates, routing and column rules on small fixtures."""

import datetime

import pytest
from helpers import frame, norm, rows
from pyspark.sql import functions as F

import millrace as mr
from millrace import routing
from millrace.functions import casts, names


def test_currency_and_error_modes(spark):
    df = frame(spark, "id int, a string", [
        (1, "$1,200.50"), (2, "€ 3"), (3, "abc"), (4, " "), (5, None), (6, "1d"), (7, "nan")])
    rule = [{"column": "a", "target_type": "float"}, {"column": "gone", "target_type": "float"}]

    def run(mode):
        return mr.cast_types(df, rule, strip_currency=True, on_error=mode, report_columns=["id"])

    assert rows(run("nullify").result) == norm(
        [(1, 1200.5), (2, 3.0), (3, None), (4, None), (5, None), (6, None), (7, None)])
    assert rows(run("drop_row").result, "id") == norm([(1,), (2,), (4,), (5,), (7,)])
    kept = {r["id"]: r["a"] for r in run("keep_original").result.collect()}
    assert kept == {1: "1200.5", 2: "3.0", 3: "abc", 4: None, 5: None, 6: "1d", 7: None}
    report = run("nullify").errors
    assert report.columns == ["id", "column", "original_value", "target_type", "error"]
    assert rows(report, "id", "original_value") == norm([(3, "abc"), (6, "1d")])
    with pytest.raises(ValueError):
        run("ignore")


def test_integers(spark):
    df = frame(spark, "a string", [("12.0",), ("12.5",), ("1e3",), ("9223372036854775807",),
                                   ("9223372036854775808",), ("+7",), ("-8.",)])
    got = [r["a"] for r in mr.cast_types(df, [{"column": "a", "target_type": "integer"}])
           .result.collect()]
    assert got == [12, None, 1000, 9223372036854775807, None, 7, -8]


def test_later_rules_skip_dropped_rows(spark):
    df = frame(spark, "a string, b string", [("x", "y"), ("1", "z"), ("2", "3")])
    out = mr.cast_types(df, [{"column": "a", "target_type": "integer"},
                             {"column": "b", "target_type": "integer"}], on_error="drop_row")
    assert rows(out.result) == [(2.0, 3.0)]
    assert rows(out.errors, "column", "original_value") == norm([("a", "x"), ("b", "z")])


@pytest.mark.parametrize("fmt,good,bad,when", [
    ("%d/%m/%Y", "3/01/2025", "2025-13-01", datetime.datetime(2025, 1, 3)),
    ("%Y%m%d", "20250103", "2025-01-03", datetime.datetime(2025, 1, 3)),
    ("%d-%b-%Y", "03-JAN-2025", "03-XXX-2025", datetime.datetime(2025, 1, 3)),
    ("%Y-%m-%d %H:%M:%S", "2025-01-03 04:05:06", "2025-01-03", datetime.datetime(2025, 1, 3, 4, 5, 6)),
    (None, "2025-01-03T04:05:06", "soon", datetime.datetime(2025, 1, 3, 4, 5, 6)),
])
def test_dates(spark, fmt, good, bad, when):
    df = frame(spark, "d string", [(good,), (bad,), (None,)])
    out = mr.cast_types(df, [{"column": "d", "target_type": "date", "format": fmt}])
    assert [r["d"] for r in out.result.collect()] == [when, None, None]
    assert [(r["original_value"], r["error"]) for r in out.errors.collect()] == [
        (bad, f"cast_failed (expected format: {fmt})")]


def test_booleans_report_failures(spark):
    df = frame(spark, "b string", [("yes",), (" N ",), ("1",), ("maybe",), (None,)])
    out = mr.cast_types(df, [{"column": "b", "target_type": "boolean"}])
    assert [r["b"] for r in out.result.collect()] == [True, False, True, None, None]
    assert rows(out.errors, "original_value") == [("maybe",)]


def test_date_pattern_quotes_literals():
    assert casts.date_pattern("%Y-%m-%dT%H:%M")[0] == "yyyy-M-d'T'H:m"
    with pytest.raises(ValueError):
        casts.date_pattern("%Q")


def test_trim_removes_all_whitespace(spark):
    df = frame(spark, "a string", [("\t x \n",), ("nan",)])
    assert [r["a"] for r in mr.cast_types(df, [], trim_strings=True).result.collect()] == ["x", None]


def test_predicates(spark):
    df = frame(spark, "s string, n int", [("a", 1), ("b", 2), (None, 3), ("5", None)])

    def ids(*clauses):
        return [r["s"] for r in mr.filter_rows(df, list(clauses)).collect()]

    assert ids(("s", "!=", "a")) == ["b", None, "5"]
    assert ids(("s", "==", "5")) == ["5"]
    assert ids(("n", ">=", "2"), ("s", "==", "a", "or")) == ["a", "b", None]
    assert ids(("n", "==", "abc")) == []
    assert ids(("n", "!=", "abc")) == ["a", "b", None, "5"]
    assert ids(("n", "in", "1, 3")) == ["a", None]
    assert ids(("s", "contains", "^[ab]"), ("n", "<", "2")) == ["a"]
    assert ids(("", "==", "x"), ("s", "==", " ")) == ["a", "b", None, "5"]
    # "and" binds tighter than "or"
    assert ids(("s", "==", "a"), ("s", "==", "b", "or"), ("n", "==", "9", "and")) == ["a"]
    with pytest.raises(ValueError):
        ids(("s", "like", "x"))
    with pytest.raises(KeyError):
        ids(("gone", "==", "x"))


def test_rules_send_rows_to_several_routes(spark):
    df = frame(spark, "id int, status string, amount double",
               [(1, "PAID", 10.0), (2, "OPEN", 500.0), (3, "VOID", None), (4, None, 900.0)])
    rules = {"open": "status = 'OPEN'", "big": [("amount", ">", "100")]}
    out = routing.by_rules(df, rules)
    assert rows(out, "id", "_route") == norm([
        (1, "unmatched"), (2, "open"), (2, "big"), (3, "unmatched"), (4, "big")])
    assert rows(routing.by_rules(df, rules, None), "id") == norm([(2,), (2,), (4,)])
    assert {k: v.count() for k, v in routing.routes(out, ["open", "big", "unmatched"]).items()} == {
        "open": 1, "big": 2, "unmatched": 2}


def test_value_routes(spark):
    df = frame(spark, "id int, s string", [(1, " paid"), (2, "OPEN"), (3, None), (4, "x")])
    groups = {"a": ["PAID", "OPEN"], "b": ["open", "X"]}
    assert rows(routing.by_values(df, "s", groups), "id", "_route") == norm(
        [(1, "a"), (2, "a"), (3, "others"), (4, "b")])
    assert rows(routing.by_values(df, "s", groups, None, case_sensitive=True), "id", "_route") \
        == norm([(2, "a")])
    assert rows(routing.by_values(df, "gone", groups), "_route") == [("unchanged",)] * 4
    with pytest.raises(ValueError):
        routing.by_values(df, "s", {"a": []})


@pytest.mark.parametrize("nulls", ["separate_file", "merge_into_remaining", "discard"])
@pytest.mark.parametrize("remaining", ["separate_file", "discard"])
def test_group_routes_partition_the_input(spark, nulls, remaining):
    df = frame(spark, "id int, s string", [(1, "A"), (2, "b"), (3, None), (4, "x"), (5, " a")])
    out = routing.by_groups(df, "s", {"ab": "a, b"}, nulls=nulls, remaining=remaining)
    want = {1: "ab", 2: "ab"}
    if remaining == "separate_file":
        want.update({4: "remaining", 5: "remaining"})
    if nulls == "separate_file":
        want[3] = "null"
    elif nulls == "merge_into_remaining" and remaining == "separate_file":
        want[3] = "remaining"
    assert {r["id"]: r["_route"] for r in out.collect()} == want
    with pytest.raises(KeyError):
        routing.by_groups(df, "gone", {"ab": "a"})


def test_unsafe_values_share_a_route(spark, tmp_path):
    df = frame(spark, "id int, s string", [(1, "a/b"), (2, "a b"), (3, None)])
    out = routing.by_distinct(df, "s", template="{split_column}_{value}")
    assert rows(out, "id", "_route") == norm([(1, "s_a_b"), (2, "s_a_b"), (3, "s_NULL")])
    folders = routing.write_routes(out, str(tmp_path / "o"), "csv", original=df)
    back = spark.read.option("header", True).csv(folders[0])
    assert rows(back, "_route") == [("s_NULL",), ("s_a_b",), ("s_a_b",)]
    assert spark.read.option("header", True).csv(folders[1]).count() == 3


def test_conform(spark):
    a = frame(spark, "id int, AMT int", [(1, 2)])
    b = frame(spark, "` Id ` int, ` amt ` int, extra int", [(3, 4, 9)])
    c = frame(spark, "x int", [(5,)])
    out = mr.union([a, b, c], output_columns='["id", "amt"]')
    assert out.columns == ["id", "amt"]
    assert rows(out) == norm([(1, 2), (3, 4), (5, None)])


def test_names():
    assert names.unique_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    assert names.unique_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    assert names.parse_names(" a, b ,") == ["a", "b"]
    assert names.parse_names("") is None
    with pytest.raises(TypeError):
        names.parse_names(3)


def test_join_names(spark):
    a = frame(spark, "k int, v int", [(1, 2)])
    b = frame(spark, "k int, v int, w int", [(1, 3, 4)])
    assert mr.join(a, b, "k").columns == ["k", "v_x", "v_y", "w"]
    assert mr.join(a, b, "k", suffixes=("", "_r")).columns == ["k", "v", "v_r", "w"]
    with pytest.raises(ValueError, match="overlap"):
        mr.join(a, b, "k", suffixes=("", ""))
    with pytest.raises(KeyError, match="available"):
        mr.join(a, b, "z")
    with pytest.raises(ValueError):
        mr.join(a, b.withColumn("k", F.lit("1")), "k")
    out = mr.join_tables(a, b, "k", right_columns=["k", "w"], drop=["v", "gone"], move=("k", "w"))
    assert out.columns == ["w", "k"]


def test_denormalize_and_chain(spark):
    master = frame(spark, "cust int, name string", [(1, "a"), (2, "b")])
    detail = frame(spark, "cid int, no int", [(1, 10), (1, 11)])
    out = mr.denormalize(master, detail, left_on="cust", right_on="cid", prefix="inv_")
    assert out.columns == ["cust", "name", "inv_no"]
    assert rows(out) == norm([(1, "a", 10), (1, "a", 11), (2, "b", None)])
    with pytest.raises(ValueError):
        mr.join_chain(master, [{"table": detail}])


def test_null_tools(spark):
    df = frame(spark, "a string, n int", [("x", 1), ("N/K", None), (None, None)])
    out = mr.handle_nulls(df, [{"column": "n", "strategy": "fill", "fill_value": "0"}],
                          null_tokens=["N/K"])
    assert rows(out.result) == norm([("x", 1), (None, 0), (None, 0)])
    assert rows(out.audit) == norm([("a", 2, 3, 66.67), ("n", 2, 3, 66.67)])
    assert mr.handle_nulls(df, [{"column": "*", "strategy": "drop_row"}]).result.count() == 1
    with pytest.raises(ValueError, match="needs"):
        mr.handle_nulls(df, [{"column": "n", "strategy": "fill", "fill_value": "x"}])
    with pytest.raises(ValueError):
        mr.handle_nulls(df, [{"column": "n", "strategy": "guess"}])


def test_aggregate_rules(spark):
    df = frame(spark, "k string, v double, s string",
               [("a", None, None), ("a", None, None), (None, 1.0, "z")])
    out = mr.aggregate(df, ["k"], [("v", "sum"), ("v", "count"), ("v", "mean"), ("s", "concat"),
                                   ("gone", "sum")], order_by=["v"])
    assert rows(out) == norm([("a", 0, 0, None, "")])
    assert rows(mr.aggregate(df, ["k"])) == norm([("a",), (None,)])
    assert rows(mr.aggregate(df, ["k"], [("s", "concat")], order_by=["v"])) == norm(
        [("a", ""), (None, None)])
    with pytest.raises(ValueError):
        mr.aggregate(df, ["k"], [("v", "mad")])
    with pytest.raises(ValueError, match="order_by"):
        mr.aggregate(df, ["k"], [("v", "first")])
    with pytest.raises(KeyError):
        mr.aggregate(df, ["gone"], [("v", "sum")])
    with pytest.raises(ValueError, match="exist"):
        mr.attach_aggregates(df, ["k"], [("v", "sum", "s")])


def test_profile_and_chain(spark):
    df = frame(spark, "a int, b string", [(1, "x"), (1, None), (2, "y")])
    got = {r["column"]: r.asDict() for r in mr.profile(df).collect()}
    assert got["a"]["unique"] == 2 and got["a"]["top_value"] == "1"
    assert got["b"] == {"column": "b", "type": "string", "non_null": 2, "null_pct": 33.3,
                        "unique": 2, "min": "x", "max": "y", "top_value": "x"}
    approx = {r["column"]: r["unique"] for r in mr.profile(df, approximate=True).collect()}
    assert approx == {"a": 2, "b": 2}
    nested = frame(spark, "a int, m map<string, int>, l array<int>", [(1, {"x": 1}, None), (1, None, None)])
    assert {r["column"]: r["null_pct"] for r in mr.profile(nested).collect()} == {"a": 0, "m": 50, "l": 100}
    only = {r["column"]: r["non_null"] for r in mr.profile(nested.select("l"), approximate=True).collect()}
    assert only == {"l": 0}
    with pytest.raises(KeyError) as e:
        mr.chain(df, lambda d: mr.drop_columns(d, ["b"]),
                 lambda d: mr.aggregate(d, ["b"], [("a", "sum")]))
    assert "step 2" in e.value.__notes__[0]


def test_top_values_are_proven_or_left_out(spark):
    n = 60_000
    df = spark.range(n, numPartitions=8).select(
        F.col("id").alias("unique"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.col("id").cast("string")).alias("heavy"), (F.col("id") % 4).alias("tie"),
        F.lit(None).cast("string").alias("blank"), F.when(F.col("id") < 5, 1.5).alias("few"))
    got = {r["column"]: (r["top_value"], r["top_count"]) for r in mr.top_values(df).collect()}
    assert got == {"unique": (None, None), "heavy": ("hot", n // 3), "tie": ("0", n // 4),
                   "blank": (None, None), "few": ("1.5", 5)}
    assert mr.top_values(df.limit(0)).where("top_value is not null").count() == 0


def test_delta_tells_nulls_and_nested_values_apart(spark):
    def side(*values):
        return frame(spark, "k int, a string, b string, d double, l array<int>",
                     [(i, *v) for i, v in enumerate(values)])

    one = side((None, "x", 0.0, [None, 1]), ("xy", "z", None, []), (None, None, float("nan"), None))
    two = side(("x", None, 0.0, [None, 1]), ("x", "yz", None, []), (None, None, float("nan"), None))
    three = side((None, "x", -0.0, [1, None]), ("xy", "z", None, []), (None, None, float("nan"), None))
    for names, other, changed in ((["a", "b", "d"], two, [0, 1]), (["a", "b", "d"], three, []),
                                  (["a", "l"], two, [0, 1]), (["l"], three, [0])):
        out = mr.delta(one, other, ["k"], compare=names)
        assert sorted(r["k"] for r in out.collect()) == changed


def test_row_operators_accept_streams(spark, tmp_path):
    frame(spark, "id int, s string", [(1, "a"), (2, "b")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, s string").parquet(str(tmp_path / "in"))
    routed = routing.by_values(mr.rename(stream, {"id": "key"}), "s", {"first": ["A"]})
    q = routed.writeStream.format("memory").queryName("routed").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("routed"), "key", "_route") == norm([(1, "first"), (2, "others")])
