"""What the plans have to look like at scale: pushed filters, split hot keys, no full windows."""

import pytest
from helpers import frame, rows
from pyspark.sql import functions as F

import millrace as mr
from millrace.operators.aggregate import attach_top
from millrace.session import scratch_path

ORDERS = "/root/testdata/sf0.01/orders.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The final plan, after running the query."""
    df.collect()
    return plan(df)


@pytest.fixture
def settings(spark):
    """Thresholds lowered so that small data shows what large data would do."""
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in lowered}
    for k, v in lowered.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """20,000 rows of which more than a third share one key."""
    return spark.range(20000, numPartitions=8).select(
        F.col("id"), F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 500).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"))


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_hot_join_keys_are_split(spark, settings, hot, how):
    few = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("w"))
    sides = (few, hot) if how == "right" else (hot, few)
    assert "skew=true" in ran(mr.join(*sides, "k", how=how))


def test_attached_aggregates_use_no_window_and_split(spark, settings, hot):
    out = mr.attach_aggregates(hot, ["k"], [("id", "max", "top"), ("*", "count", "n")])
    text = ran(out)
    assert "Window" not in text and "skew=true" in text


def test_duplicate_report_splits(spark, settings, hot):
    assert "skew=true" in ran(mr.deduplicate(hot, ["k"], "none").duplicates)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedup_prunes_before_the_shuffle(hot, keep):
    text = plan(mr.deduplicate(hot, ["k"], keep, ["id"]).result)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_top_n_prunes_before_the_shuffle(hot):
    text = plan(mr.rank_rows(hot, "id", ["k"], top_n=3, order_by=["id"]).result)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    orders = spark.read.parquet(ORDERS)
    text = plan(mr.aggregate(
        mr.filter_rows(orders, [("o_totalprice", ">", "1000"), ("o_orderstatus", "!=", "F")]),
        ["o_orderpriority"], [("o_totalprice", "sum")]))
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "IsNotNull(o_orderpriority)" in text and "EqualNullSafe(o_orderstatus,F)" in text
    assert "o_orderdate" not in text and "o_custkey" not in text


def test_row_operators_add_no_shuffle(spark):
    orders = spark.read.parquet(ORDERS)
    routed = mr.routing.by_groups(mr.rename(orders, {"o_orderkey": "id"}), "o_orderstatus",
                                  {"done": ["F"]})
    cast = mr.cast_types(routed, [{"column": "o_custkey", "target_type": "string"}])
    assert "Exchange" not in plan(cast.result) and "Exchange" not in plan(cast.errors)


def test_delta_never_pairs_repeated_keys(spark):
    many = spark.range(30000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("v"))
    out = mr.delta(many, many.limit(20000), ["k"])
    assert out.count() == 30000


def test_delta_keeps_digests_only(spark):
    left = spark.range(1000).select("id", F.col("id").cast("string").alias("s"))
    out = mr.delta(left, left.withColumn("s", F.concat("s", F.lit("x"))), ["id"], mode="changed_only")
    assert "SortAggregate" not in plan(out) and "HashAggregate" in plan(out)


def test_concatenation_is_gated_by_bytes(spark, monkeypatch):
    from millrace.plans import ordered

    df = spark.range(300).select("id", F.lit("k").alias("k"), F.expr("repeat('x', 1000)").alias("text"))
    assert ordered.sizes(df, ["k"], ["text"])[:] == (300, 300, 300_000, 300_000)
    monkeypatch.setattr(ordered, "GROUP_BYTES", 20_000)
    size = ordered.sizes(df, ["k"], ["text"])
    assert not size.fit(None) and size.chunks == 15 and ordered.sizes(df, ["k"]).fit(None)
    rows_ = ordered.in_chunks(df, ["k"], [F.col("id").asc()], "c", size, "t")
    assert rows_.groupBy("c").count().agg(F.max("count")).first()[0] <= 60
    out = mr.aggregate(df, ["k"], [("text", "concat")], order_by=["id"]).first()
    assert out["text_concat"] == "|".join(["x" * 1000] * 300)


def test_chunked_results_survive_recomputation(spark, hot):
    """The carry table and the rows come from one written table, not from two shuffles."""
    from millrace.plans.ordered import number
    out = number(hot, "k", [], "n", method="row_number", order_by=["id"], max_group_rows=0)
    text = plan(out)
    assert "rangepartitioning" not in text and "BroadcastHashJoin" in text
    assert out.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (20000, 1, 20000)


def test_attach_top_reads_only_matching_groups(spark):
    df = frame(spark, "k string, v int", [("a", 1), ("a", 9), ("b", 5), (None, 50), ("c", None)])
    out = attach_top(df, ["k"], [("v", "max", "m")], "m", 2)
    assert rows(out, "k", "v", "rank") == [("a", 1, 1), ("a", 9, 1)]


def test_scratch_folder_follows_the_session(spark):
    assert scratch_path(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
