"""Lineage by reference: the same rows as arrays of them, and no row that holds more than a few entries."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from sluice.operators import CrosstableUDF, CumAggr, DropDuplicate, GroupBy, InnerJoin, LeftOuterJoin, SemiJoin, Subquery, agg
from sluice.operators.base import LINEAGE
from sluice.pipeline import Pipeline
from sluice.plans import catalog, operator_queries, tpch
from sluice.predicate import col, row_predicate
from sluice.sources import FrameTable

GATHERING = {
    "q17": tpch.q17, "q22": tpch.q22,
    **{k: operator_queries.PIPELINES[k] for k in ("cum_sum", "cum_max_by_user", "all_aggregate", "scalar_computation", "set_item_with_dependency", "grouped_map_table", "cogrouped_map", "pivot", "crosstable_condition")},
}


def entries(df):
    return {(r.source, r.rid) for r in df.select(F.explode(LINEAGE).alias("l")).select("l.*").collect()}


def both(p, f):
    tracked, (referred, refs) = p.tracked(), p.referred()
    names = sorted({s.table for s in p.sources})
    return entries(tracked.filter(f.to_column())), {(r.source, r.rid) for r in refs.resolved(referred.filter(f.to_column()), names).collect()}


@pytest.mark.parametrize("name", sorted(GATHERING))
def test_no_row_holds_what_it_gathers(spark, small, name):
    p = Pipeline(spark, GATHERING[name](catalog.tables(small)))
    assert p.referred()[0].agg(F.max(F.size(LINEAGE))).first()[0] <= 8
    rows = p.frame().orderBy(*[f"`{c}`" for c in p.frame().columns]).limit(5).collect()
    want, found = both(p, row_predicate(rows[len(rows) // 2]))
    assert found == want and want


@pytest.fixture
def odd(spark):
    """Keys that only look different, that only look alike, and none at all."""
    t, n = datetime.datetime(2024, 3, 31, 1, 30, 0, 123456), float("nan")
    rows = [(1, 0.0, t, "a"), (2, -0.0, t, None), (3, n, t + datetime.timedelta(microseconds=1), "a"), (4, None, None, "a"), (5, n, t, ""), (6, 0.0, t, "a")]
    return FrameTable(spark.createDataFrame(rows, "id long, d double, t timestamp, s string"), "odd", ["id"])


@pytest.mark.parametrize("make", [
    lambda t: GroupBy(t, ["d"], [agg("count", alias="n")]),
    lambda t: GroupBy(t, ["t", "s"], [agg("count", alias="n")]),
    lambda t: GroupBy(GroupBy(t, ["d", "s"], [agg("count", alias="n")]), ["d"], [agg("sum", "n", "m")]),
    lambda t: DropDuplicate(t, ["d"], lineage="all"),
    lambda t: CumAggr(t, "id", "sum", ["d"], "m", partition_by=["s"]),
    lambda t: CumAggr(t, "id", "sum", ["s", "d"], "m"),
    lambda t: CrosstableUDF(t, "m", Subquery(t, [("s", "s")], agg("sum", "id", "q"), col("d") >= col("outer.d"))),
    lambda t: SemiJoin(t, GroupBy(t, ["d", "s"], [agg("count", alias="n")]), ["d"]),
])
def test_odd_keys(spark, odd, make):
    p = Pipeline(spark, make(odd))
    rows = p.frame().collect()
    assert len(rows) > 2
    for row in rows:
        want, found = both(p, row_predicate(row))
        assert found == want, row


def test_groups_keep_their_own_types_and_nulls(spark):
    """Groups share batches: a null in one makes no float of another's integers, and results of two types don't meet."""
    big, t = 2**53 + 1, "k long, i long, b boolean, s string, a array<int>"
    rows = [(1, big, True, "x", [1]), (1, big + 2, None, None, None), (2, None, False, "y", []), (2, 5, True, "", None), (None, 7, None, "z", [2, 3]), *[(k, k, True, "m", None) for k in range(10, 400) for _ in range(60)]]
    src = FrameTable(spark.createDataFrame(rows, t), "t", ["k"])

    def told(pdf):
        import pandas as pd

        n = len(pdf) if str(pdf["i"].dtype) == "int64" else float(len(pdf))
        out = pd.DataFrame({"n": [n], "top": [pdf["i"].max()], "kinds": [f"{pdf['i'].dtype} {pdf['b'].dtype} {list(pdf.index) == list(range(len(pdf)))}"], "none": [int(pdf["b"].isna().sum())]})
        return out.iloc[:0] if pdf["k"].iloc[0] == 11 else out

    from sluice.operators import GroupedMap

    schema = "n long, top long, kinds string, none long"
    df = src.read(spark)

    def plain(group, pdf):
        out = told(pdf)
        out.insert(0, "k", group[0])
        return out

    want = df.groupBy("k").applyInPandas(plain, "k long, " + schema).collect()
    found = Pipeline(spark, GroupedMap(src, ["k"], fn=told, schema=schema)).frame()
    assert sorted(map(str, found.collect())) == sorted(map(str, want)) and len(want) == 392
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()  # one exchange with Python for each group


@pytest.mark.parametrize("name", ["inner_join_null_keys", "interval_join", "interval_join_by_nation", "grouped_map_table"])
def test_many_pairs_or_groups_of_few_bytes_are_the_work_of_many_tasks(spark, small, name):
    df = Pipeline(spark, operator_queries.PIPELINES[name](catalog.tables(small.replace("sf0.001", "sf0.01")))).frame()
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(rows) >= 4 and max(rows) <= sum(rows) / 2


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("make", [InnerJoin, LeftOuterJoin])
@pytest.mark.parametrize("on", [(["s"], ["s"]), (["d"], ["d"]), (["d", "s"], ["d", "s"]), (["s", "s"], ["s", "x"])])
def test_a_join_of_few_keys_is_the_same_join(spark, odd, make, null_safe, on):
    other = FrameTable(spark.createDataFrame([(i % 7, d, s, x) for i, (d, s, x) in enumerate([(0.0, "a", "a"), (-0.0, "a", "b"), (float("nan"), None, None), (None, "", "a"), (None, None, None)] * 3)], "id long, d double, s string, x string"), "other", [])
    want, found = (Pipeline(spark, make(odd, other, *on, null_safe=null_safe, few_keys=few)).frame() for few in (False, True))
    assert found.columns == want.columns and [f.dataType for f in found.schema] == [f.dataType for f in want.schema]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_pairs_of_few_keys_take_little_disk(spark, tmp_path):
    left = FrameTable(spark.range(100_000).select(F.col("id").alias("a"), F.when(F.col("id") >= 100, F.lit("none")).alias("k")), "left", ["a"])
    right = FrameTable(spark.range(40_000).select(F.col("id").alias("b"), F.lit(None).cast("string").alias("j")), "right", ["b"])
    df = Pipeline(spark, InnerJoin(left, right, ["k"], ["j"], null_safe=True, few_keys=True)).frame().select("a", "b")
    df.write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.count() == pairs.distinct().count() == 4_000_000 and pairs.agg(F.max("a"), F.max("b")).first()[:] == (99, 39_999)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4_000_000 / 2
