"""Semantics the operators share with pandas, on random frames with nulls and a hot group."""

import pandas as pd
import pytest
from helpers import SCHEMA, frame, norm, pandas_rows, random_rows, rows

import millrace as mr
from millrace.plans import ordered

SEEDS = (1, 2)
SIZES = (None, 0)  # plain window, forced chunks


def both(spark, seed, n=60):
    data = random_rows(seed, n)
    return frame(spark, SCHEMA, data), pd.DataFrame(data, columns=["id", "g", "v", "s"])


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("salt", [0, 3])
def test_join(spark, seed, how, salt):
    a, pa = both(spark, seed)
    b, pb = both(spark, seed + 10, 25)
    got = mr.join(a, b, "g", how=how, suffixes=("_l", "_r"), salt=salt)
    want = pa.merge(pb, on="g", how=how, suffixes=("_l", "_r"))
    assert got.columns == list(want.columns)
    assert rows(got) == pandas_rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_join_on_differing_names_and_several_keys(spark, how):
    a, pa = both(spark, 3)
    b, pb = both(spark, 4, 25)
    names = {"g": "h", "id": "n", "v": "w"}
    got = mr.join(a, mr.rename(b, names), left_on=["g", "s"], right_on=["h", "s"], how=how)
    want = pa.merge(pb.rename(columns=names), left_on=["g", "s"], right_on=["h", "s"], how=how)
    want = want.drop(columns=["h"])
    assert rows(got, *want.columns) == pandas_rows(want)


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("method,name", [("row_number", "first"), ("rank", "min"),
                                         ("dense_rank", "dense")])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_rank(spark, seed, size, ascending, method, name, keys):
    a, pa = both(spark, seed, 200)
    a, pa = a.filter("g is not null"), pa[pa.g.notna()].copy()
    grouped = pa.groupby("g")["v"] if keys else pa["v"]
    pa["rank"] = grouped.rank(method=name, ascending=ascending, na_option="bottom")
    order = ["id"] if method == "row_number" else []
    options = dict(ascending=ascending, method=method, order_by=order, max_group_rows=size)
    got = mr.rank_rows(a, "v", keys, **options).result
    assert rows(got) == pandas_rows(pa)
    for n in (1, 4):
        kept = mr.rank_rows(a, "v", keys, top_n=n, **options)
        assert rows(kept.result) == pandas_rows(pa[pa["rank"] <= n])
    split = mr.rank_rows(a, "v", keys, top_n=4, discard=True, **options)
    assert rows(split.discarded) == pandas_rows(pa[pa["rank"] > 4])
    assert rows(split.result) == pandas_rows(pa[pa["rank"] <= 4])


@pytest.mark.parametrize("method", ["rank", "dense_rank"])
def test_one_value_fills_many_chunks(spark, method):
    data = [(i, "g", 1.0 if i % 10 else float(i), "s") for i in range(500)]
    a = frame(spark, SCHEMA, data)
    pa = pd.DataFrame(data, columns=["id", "g", "v", "s"])
    pa["rank"] = pa["v"].rank(method={"rank": "min", "dense_rank": "dense"}[method])
    for order in ([], ["id"]):
        got = ordered.number(a, "v", [], "rank", method=method, order_by=order, max_group_rows=0)
        assert rows(got) == pandas_rows(pa)


@pytest.mark.parametrize("keep", ["first", "last", "none"])
@pytest.mark.parametrize("seed", SEEDS)
def test_deduplicate(spark, keep, seed):
    a, pa = both(spark, seed)
    out = mr.deduplicate(a, ["g", "s"], keep, ["id"])
    want = pa.drop_duplicates(["g", "s"], keep=False if keep == "none" else keep)
    assert rows(out.result) == pandas_rows(want)
    assert rows(out.duplicates) == pandas_rows(pa[pa.duplicated(["g", "s"], keep=False)])


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("seed", SEEDS)
def test_aggregate(spark, seed, size):
    a, pa = both(spark, seed)
    names = ["sum", "count", "mean", "min", "max", "first", "last", "nunique", "std", "var",
             "median", "prod", "sem"]
    got = mr.aggregate(a, ["g"], [("v", n) for n in names], order_by=["id"], max_group_rows=size)
    want = pa.groupby("g")["v"].agg(names).reset_index()
    assert norm(tuple(r) for r in got.collect()) == pandas_rows(want)


@pytest.mark.parametrize("size", SIZES)
def test_concat(spark, size):
    a, pa = both(spark, 5)
    got = mr.aggregate(a, ["g"], [("s", "concat", "t"), ("*", "count", "n")], order_by=["id"],
                       max_group_rows=size)
    want = pa.groupby("g").agg(t=("s", lambda s: "|".join(s.dropna())), n=("id", "size"))
    assert rows(got) == pandas_rows(want.reset_index())


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("strategy,fill", [("forward_fill", "ffill"), ("backward_fill", "bfill")])
def test_fill_along_rows(spark, size, strategy, fill):
    a, pa = both(spark, 6, 200)
    rules = [{"column": "v", "strategy": strategy}, {"column": "s", "strategy": strategy}]
    got = mr.handle_nulls(a.repartition(5, "s"), rules, order_by=["id"], max_group_rows=size).result
    want = pa.assign(v=getattr(pa.v, fill)(), s=getattr(pa.s, fill)())
    assert rows(got) == pandas_rows(want)


def test_long_gaps_cross_chunks(spark):
    data = [(i, "g", float(i) if i in (40, 300) else None, None) for i in range(400)]
    a = frame(spark, SCHEMA, data)
    got = ordered.carry_values(a, ["v"], [], ["id"], max_group_rows=0)
    want = [(i, None if i < 40 else 40.0 if i < 300 else 300.0) for i in range(400)]
    assert rows(got, "id", "v") == norm(want)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_fill_with_statistics(spark, size, strategy):
    a, pa = both(spark, 7)
    stat = pa.v.mode().iloc[0] if strategy == "mode" else getattr(pa.v, strategy)()
    got = mr.handle_nulls(a, [{"column": "v", "strategy": strategy}], max_group_rows=size).result
    assert rows(got) == pandas_rows(pa.assign(v=pa.v.fillna(stat)))


@pytest.mark.parametrize("mode", ["new_only", "changed_only", "full_delta"])
@pytest.mark.parametrize("seed", SEEDS)
def test_delta_with_repeated_keys(spark, mode, seed):
    a, pa = both(spark, seed, 12)
    b, pb = both(spark, seed + 20, 12)
    got = mr.delta(a, b, ["g", "s"], mode=mode, compare=["v"])
    null = "<null>"
    left = pa.astype(object).where(pa.notna(), null)
    right = pb.astype(object).where(pb.notna(), null)
    keys = [tuple(k) for k in left[["g", "s"]].to_numpy()]
    known = {}
    for g, s, v in right[["g", "s", "v"]].to_numpy():
        known.setdefault((g, s), []).append(v)
    mine = {}
    for k, v in zip(keys, left["v"]):
        mine.setdefault(k, []).append(v)
    changed = {k for k in mine if k in known and any(x != y for x in mine[k] for y in known[k])}
    want = []
    for rec in left.itertuples(index=False):
        k = (rec.g, rec.s)
        status = "NEW" if k not in known else "CHANGED" if k in changed else None
        if status and (mode == "full_delta" or status == mode.split("_")[0].upper()):
            want.append((*rec, status))
    if mode == "full_delta":
        want += [(*rec, "DELETED") for rec in right.itertuples(index=False)
                 if (rec.g, rec.s) not in mine]
    assert rows(got) == norm(tuple(None if v == null else v for v in w) for w in want)


@pytest.mark.parametrize("top_n", [1, 5, 20, 45, 500])
def test_attached_top_equals_ranking_the_rows(spark, top_n):
    a, _ = both(spark, 8)
    b = frame(spark, "g string, h string", [(f"g{i}", "x") for i in range(5)] + [("hot", "y"), (None, "z")])
    options = dict(how="left", group_by=["g"], aggs=[("v", "min", "low"), ("*", "count", "n")],
                   rank_by="low")
    got = mr.join_filter_aggregate(a, b, "g", top_n=top_n, **options)
    full = mr.join_filter_aggregate(a, b, "g", **options)
    assert rows(got, *full.columns) == rows(full.filter(f"rank <= {top_n}"))


def test_union_orders_columns_as_first_seen(spark):
    a, pa = both(spark, 1, 5)
    b = frame(spark, "x long, g string", [(1, "q")])
    want = pd.concat([pa, pd.DataFrame({"x": [1], "g": ["q"]})])
    got = mr.union([a, b])
    assert got.columns == list(want.columns)
    assert rows(got) == pandas_rows(want)
