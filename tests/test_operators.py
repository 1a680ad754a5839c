"""Sources, sinks and corners of operators that queries don't reach."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sluice.lineage import lineage
from sluice.operators import AllAggregate, CumAggr, DropDuplicate, Filter, GroupBy, Join, Pivot, SetItem, SortValues, UnPivot, agg
from sluice.pipeline import Pipeline
from sluice.predicate import Lit, Opaque, col, row_predicate
from sluice.sources import CsvTable, FrameTable, ParquetTable, SqlTable, write_parquet
from sluice.streaming import follow


def test_csv_with_spaces_and_a_key(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id, name, v\n1, x, 5\n2, y,\n")
    t = CsvTable(f"file://{tmp_path}/a.csv", "a", "id int, name string, v int", ["id"])
    p = Pipeline(spark, Filter(t, col("v").is_not_null()))
    assert [tuple(r) for r in p.frame().collect()] == [(1, "x", 5)]
    assert lineage(p, row_predicate(p.frame().first()), "eager").counts() == {"a": 1}
    with pytest.raises(ValueError):
        FrameTable(p.frame(), "b").identified(spark)


def test_parquet_rows_have_an_identity(spark, small):
    df = ParquetTable(f"{small}/lineitem.parquet", "lineitem").identified(spark)
    assert df.select("__rid").distinct().count() == df.count()


def test_sql_source_and_snapshot_sink(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").createOrReplaceTempView("some")
    p = Pipeline(spark, SqlTable("SELECT * FROM some WHERE id > 1", "some", ["id"]))
    out = write_parquet(p.frame(), f"file://{tmp_path}/out", ["v"])
    assert [r.v for r in out.collect()] == ["b"] and out.columns == ["v"]


def test_running_aggregates_over_ranges_and_nulls(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 5), None if i % 11 == 0 else i % 13) for i in range(300)]
    t = FrameTable(spark.createDataFrame(rows, "id int, v double, o int"), "t", ["id"])
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    for fn, one in (("sum", lambda x: sum(x) if x else None), ("max", lambda x: max(x, default=None)), ("min", lambda x: min(x, default=None)), ("count", len)):
        got = {r.id: r.c for r in Pipeline(spark, CumAggr(t, "v", fn, ["o", "id"], "c", ranges=5)).frame().collect()}
        for k in range(len(order)):
            want = one([r[1] for r in order[: k + 1] if r[1] is not None])
            assert got[order[k][0]] == want, (fn, k)
    text = FrameTable(spark.createDataFrame([(i, chr(97 + i % 26) * (i % 4 + 1)) for i in range(100)], "id int, s string"), "s", ["id"])
    got = {r.id: r.c for r in Pipeline(spark, CumAggr(text, "id", "sum", ["s"], "c", ranges=4)).frame().collect()}
    total = 0
    for s, i in sorted((chr(97 + i % 26) * (i % 4 + 1), i) for i in range(100)):
        total += i
        assert got[i] == total


def test_pivot_refuses_two_values_in_a_cell(spark):
    t = FrameTable(spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "id int, h string, v int"), "t", ["v"])
    with pytest.raises(Exception, match="more than one value"):
        Pipeline(spark, Pivot(t, ["id"], "h", "v", ["x"], None)).frame().collect()


def test_unpivot_selects_the_row_of_one_variable(spark):
    t = FrameTable(spark.createDataFrame([(1, 5, 6), (2, 6, 5)], "id int, x int, y int"), "t", ["id"])
    p = Pipeline(spark, UnPivot(t, ["id"], ["x", "y"]))
    got = lineage(p, (col("variable") == "x") & (col("value") == 6))
    assert [r.id for r in got["t"].rows.collect()] == [2] and got["t"].exact


def test_function_that_is_not_deterministic_blocks_the_push(spark):
    import pandas as pd

    t = FrameTable(spark.createDataFrame([(1,), (2,)], "id int"), "t", ["id"])
    p = Pipeline(spark, SetItem(t, "r", Opaque(lambda s: pd.Series([1.0] * len(s)), (col("id"),), "double", pure=False)))
    s = lineage(p, (col("r") == 1.0) & (col("id") == 2), "pushdown")["t"]
    assert s.status.name == "BLOCKED" and not s.exact
    assert lineage(p, (col("r") == 1.0) & (col("id") == 2)).counts() == {"t": 1}


def test_empty_inputs(spark):
    t = FrameTable(spark.createDataFrame([], "id int, v int"), "t", ["id"])
    assert Pipeline(spark, GroupBy(t, ["v"], [agg("count", alias="n")])).frame().collect() == []
    assert Pipeline(spark, AllAggregate(t, [agg("count", alias="n"), agg("sum", "v", "s")])).frame().collect() == [(0, None)]
    assert Pipeline(spark, DropDuplicate(t, ["v"])).frame().collect() == []
    assert Pipeline(spark, AllAggregate(t, fold=(0, lambda s, r: s + r["v"], lambda a, b: a + b), returns="bigint")).frame().collect() == [(0,)]
    assert Pipeline(spark, Join(t, t, ["id"], how="full")).frame().collect() == []
    assert Pipeline(spark, CumAggr(t, "v", "sum", ["id"])).frame().collect() == []


def test_row_wise_pipeline_follows_a_stream(spark, small, tmp_path):
    events = ParquetTable(f"{small}/events.parquet", "events")
    p = Pipeline(spark, SetItem(Filter(events, col("value") > 50), "kind", Lit("big")))
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.parquet(f"{tmp_path}/in/events")
    stream = spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).parquet(f"{tmp_path}/in/events")
    q = follow(p, {"events": stream}).writeStream.format("memory").queryName("followed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("followed").count() == p.frame().count()
    with pytest.raises(TypeError):
        follow(Pipeline(spark, GroupBy(events, ["user_id"], [agg("count")])), {"events": stream})


def test_fold_keeps_its_tasks_and_its_result_however_rows_are_dealt(spark):
    df = spark.range(1000).withColumnRenamed("id", "v")
    for n in (1, 4, 8):
        t = FrameTable(df.repartition(n), "t", ["v"])
        p = Pipeline(spark, AllAggregate(t, fold=(0, lambda s, r: s + r["v"], lambda a, b: a + b), returns="bigint"))
        assert p.frame().collect() == [(499500,)]
        plan = p.frame()._jdf.queryExecution().executedPlan().toString()
        merge, fold = [m.start() for m in re.finditer("MapInPandas", plan)][:2]
        assert "Exchange SinglePartition" in plan[merge:fold] and "Coalesce" not in plan
        states = Pipeline(spark, t).frame().rdd.getNumPartitions()
        assert states == n
        bad = Pipeline(spark, AllAggregate(t, fold=(10, lambda s, r: s + r["v"], lambda a, b: a + b), returns="bigint"))
        with pytest.raises(Exception, match="must change nothing"):
            bad.frame().collect()


def test_drop_duplicate_keeps_the_first_row_with_nulls_last(spark):
    rows = [(1, None, "b"), (1, 5, None), (1, 5, "a"), (2, None, None), (2, None, "z"), (None, 3, "q"), (None, 2, "r"), (3, 1, "x"), (3, 1, "x")]
    t = FrameTable(spark.createDataFrame(rows, "k int, v int, s string"), "t", ["k"])
    p = Pipeline(spark, DropDuplicate(t, ["k"], ["v"]))
    assert sorted(map(tuple, p.frame().collect()), key=str) == sorted([(1, 5, "a"), (2, None, "z"), (None, 2, "r"), (3, 1, "x")], key=str)
    assert p.frame().columns == ["k", "v", "s"]
    plan = p.frame()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan
    assert sorted(map(tuple, Pipeline(spark, DropDuplicate(t, ["k", "v", "s"])).frame().collect()), key=str) == sorted(set(rows), key=str)
    assert sorted(map(tuple, Pipeline(spark, DropDuplicate(t, ["k"], ["k", "s"])).frame().collect()), key=str) == sorted([(1, 5, "a"), (2, None, "z"), (None, 3, "q"), (3, 1, "x")], key=str)


def test_duplicates_with_map_columns(spark):
    rows = [(1, {"b": 2, "a": 1}, [{"x": 1}]), (1, {"a": 1}, [{"y": 2}]), (2, None, None), (2, {"z": 0}, [])]
    df = spark.createDataFrame(rows, "k int, m map<string,int>, l array<map<string,int>>")
    for order in ([], ["m"], ["l"]):
        p = Pipeline(spark, DropDuplicate(FrameTable(df, "t", ["k"]), ["k"], order))
        got = p.frame().collect()
        assert sorted(r.k for r in got) == [1, 2] and all((r.k, r.m, r.l) in rows for r in got)
        assert next(r for r in got if r.k == 2).m == {"z": 0}


def test_running_ranges_are_cut_where_strings_share_a_prefix(spark):
    df = spark.range(20_000).select(F.format_string("Customer#%09d", (F.col("id") * 7919) % 20_000).alias("s"), F.lit(1).alias("v"))
    p = Pipeline(spark, CumAggr(FrameTable(df, "t"), "v", "sum", ["s"], "c", ranges=16))
    got = p.frame()
    assert [r.c for r in got.orderBy("s").collect()] == list(range(1, 20_001))
    sizes = [r["count"] for r in spark.read.parquet(*got.inputFiles()).groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4_000


def test_sort_is_in_order(spark):
    rows = [(2, None), (1, 5.0), (None, 1.0), (1, None), (2, 7.0)]
    t = FrameTable(spark.createDataFrame(rows, "a int, b double"), "t")
    assert [tuple(r) for r in Pipeline(spark, SortValues(t, ["a", "b"], [True, False])).frame().collect()] == [(2, 7.0), (2, None), (1, 5.0), (1, None), (None, 1.0)]
