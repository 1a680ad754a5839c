"""The three ways to an answer agree, on every pipeline that is registered."""

from __future__ import annotations

import re

import pytest

from sluice.lineage import SnapshotStore, drop_by_key, eager_lineage, lineage, measure, plan_snapshots, push_down, same_rows, verify_pruning
from sluice.lineage.answer import without_limits
from sluice.operators import AntiJoin, Append, CrosstableUDF, DropDuplicate, Filter, GroupBy, InnerJoin, Join, LeftOuterJoin, Rename, Select, SemiJoin, SetItem, Status, Subquery, TopN, UnPivot, agg
from sluice.pipeline import Pipeline
from sluice.plans import catalog, operator_queries, tpch
from sluice.predicate import Case, Lit, all_of, any_of, col, random_predicate, row_predicate, schema_predicate
from sluice.sources import FrameTable, ParquetTable, write_parquet

PIPELINES = {**{f"tpch_{k}": v for k, v in tpch.PIPELINES.items()}, **operator_queries.PIPELINES}


@pytest.mark.parametrize("name", sorted(PIPELINES))
def test_pushed_lineage_is_eager_lineage(spark, small, name):
    p = Pipeline(spark, PIPELINES[name](catalog.tables(small)))
    rows = p.frame().orderBy(*[f"`{c}`" for c in p.frame().columns]).limit(5).collect()
    if not rows:
        pytest.skip("no row at this size")
    f = row_predicate(rows[len(rows) // 2])
    found, want = lineage(p, f), eager_lineage(p, f)
    for table, s in found.sources.items():
        assert s.exact and same_rows(s.rows, want[table].rows), (table, s.status, s.predicate.to_sql())
    assert verify_pruning(p, f)


@pytest.mark.parametrize("name", ["q3", "q5", "q10", "q18"])
def test_snapshots_make_it_exact(spark, small, tmp_path, name):
    p = Pipeline(spark, tpch.PIPELINES[name](catalog.tables(small)))
    f = row_predicate(p.frame().first())
    store = SnapshotStore(f"file://{tmp_path}")
    store.build(p)
    found, want = lineage(p, f, "snapshot", store), eager_lineage(p, f)
    for table, s in found.sources.items():
        assert same_rows(s.rows, want[table].rows), table


def test_snapshot_plan_of_q3_is_the_join_that_loses_the_customer(spark, small):
    p = Pipeline(spark, tpch.q3(catalog.tables(small)))
    plan = plan_snapshots(p)
    assert len(plan) == 1 and isinstance(plan[0].node, InnerJoin) and {"c_custkey", "o_orderkey"} <= set(plan[0].columns)


def test_predicate_without_a_row_has_no_lineage(spark, small):
    p = Pipeline(spark, tpch.q1(catalog.tables(small)))
    assert lineage(p, col("l_returnflag") == "nothing").counts() == {"lineitem": 0}


def test_pushdown_alone_says_that_it_is_a_superset(spark, small):
    p = Pipeline(spark, tpch.q3(catalog.tables(small)))
    s = lineage(p, row_predicate(p.frame().first()), "pushdown")
    assert s["lineitem"].exact and not s["customer"].exact and s["customer"].reasons


def frame(spark, rows, schema, table, key=("id",)):
    return FrameTable(spark.createDataFrame(rows, schema), table, list(key))


def test_composite_keys_are_compared_as_tuples(spark):
    a = frame(spark, [(1, 1, "a"), (2, 2, "b"), (3, 1, "b"), (4, 2, "a")], "id int, x int, y string", "a")
    b = frame(spark, [(1, 1, "a", 5.0), (2, 2, "b", 6.0)], "id int, x int, y string, v double", "b")
    p = Pipeline(spark, GroupBy(InnerJoin(a, b, ["x", "y"]), ["v"], [agg("count", alias="n")]))
    f = any_of([row_predicate(r) for r in p.frame().collect()])
    found = lineage(p, f)
    assert sorted(r.id for r in found["a"].rows.collect()) == [1, 2]


def test_unmatched_row_of_a_left_join(spark):
    a = frame(spark, [(1, 10), (2, 20), (3, None)], "id int, k int", "a")
    b = frame(spark, [(1, 10, None), (2, 30, "z")], "id int, k int, v string", "b")
    p = Pipeline(spark, LeftOuterJoin(a, b, ["k"]))
    for row in p.frame().collect():
        f = row_predicate(row)
        found, want = lineage(p, f), eager_lineage(p, f)
        assert verify_pruning(p, f)
        for t in "ab":
            assert same_rows(found[t].rows, want[t].rows), (row, t)


def test_two_consumers_of_one_source(spark):
    a = frame(spark, [(i, i % 3) for i in range(9)], "id int, g int", "a")
    p = Pipeline(spark, InnerJoin(Filter(a, col("id") < 5), Filter(a, col("id") > 3), ["g"]))
    f = row_predicate(p.frame().orderBy("id_x", "id_y").first())
    assert same_rows(lineage(p, f)["a"].rows, eager_lineage(p, f)["a"].rows)


def test_overwritten_column_and_fill_value_equal_to_a_real_one(spark):
    a = frame(spark, [(1, None), (2, 0), (3, 7)], "id int, v int", "a")
    filled = SetItem(a, "v", Case(((col("v").is_null(), Lit(0)),), col("v")))
    p = Pipeline(spark, GroupBy(filled, ["v"], [agg("count", alias="n")]))
    assert sorted(r.id for r in lineage(p, row_predicate({"v": 0, "n": 2}))["a"].rows.collect()) == [1, 2]


def test_duplicate_rows_are_all_lineage(spark):
    a = frame(spark, [(1, "x"), (2, "x"), (3, "y")], "id int, v string", "a")
    p = Pipeline(spark, GroupBy(a, ["v"], [agg("count", alias="n")]))
    assert lineage(p, row_predicate({"v": "x", "n": 2})).counts() == {"a": 2}


def test_top_n_at_a_tie(spark):
    a = frame(spark, [(i, 5) for i in range(6)], "id int, v int", "a")
    p = Pipeline(spark, TopN(a, 3, ["v"]))
    f = row_predicate({"id": 2, "v": 5})
    assert lineage(p, f).counts() == {"a": 1} and verify_pruning(p, f)


def test_empty_source(spark):
    a = frame(spark, [], "id int, v int", "a")
    p = Pipeline(spark, GroupBy(a, ["v"], [agg("count", alias="n")]))
    assert lineage(p, col("v") == 1).counts() == {"a": 0}


def test_measured_constraints_drop_atoms(spark):
    df = spark.createDataFrame([(i, i % 2, None if i == 3 else i) for i in range(20)], "k int, g int, v int")
    c = measure(df)
    assert c.unique == {frozenset({"k"})} and c.domain["g"] == (0, 1) and c.ranges["k"] == (0, 19) and c.non_empty
    f = all_of([col("k") == 1, col("v") > 3])
    assert drop_by_key(f, c.unique, {"v"}).columns() == {"k"}
    assert drop_by_key(col("v") > 3, c.unique, {"v"}).columns() == {"v"}


def test_group_key_not_fixed_is_a_superset(spark, small):
    p = Pipeline(spark, GroupBy(catalog.tables(small)("orders"), ["o_custkey"], [agg("sum", "o_totalprice", "t")]))
    pushed = push_down(p, col("t") > 100000)
    assert pushed[p.sources[0]].status == Status.SUPERSET
    f = col("t") > 400000
    assert same_rows(lineage(p, f)["orders"].rows, eager_lineage(p, f)["orders"].rows)


def small_pipelines(spark):
    rows = [(i, i % 4 if i % 5 else None, "ab"[i % 2] if i % 3 else None, float(i % 3)) for i in range(24)]
    a = frame(spark, rows, "id int, k int, s string, v double", "a")
    b = frame(spark, [(i, i % 6, "abc"[i % 3]) for i in range(12)] + [(90, None, None)], "id int, k int, t string", "b")
    yield "group", GroupBy(Filter(a, col("v") > 0), ["k", "s"], [agg("sum", "v", "total"), agg("count", alias="n")])
    yield "inner", InnerJoin(a, b, ["k"])
    yield "left", LeftOuterJoin(a, b, ["k"])
    yield "right", Join(a, b, ["k"], how="right")
    yield "full", Join(a, b, ["k"], how="full")
    yield "full, other names", Join(a, Rename(b, {"k": "kb"}), ["k"], ["kb"], how="full")
    yield "null-safe", Join(a, Rename(b, {"k": "kb"}), ["k"], ["kb"], how="left", null_safe=True)
    yield "semi", SemiJoin(a, b, ["k"], condition=col("right.id") < col("id"))
    yield "anti", AntiJoin(a, b, ["k"], condition=col("right.id") < col("id"))
    yield "union", Append([Select(a, ["id", "k", "s"]), Rename(Select(b, ["id", "t"]), {"t": "s"})])
    yield "top", TopN(a, 7, ["v", "id"], [True, False])
    yield "first", DropDuplicate(a, ["k"], ["id"])
    yield "melt", UnPivot(Select(SetItem(a, "w", col("v") * 2), ["id", "v", "w"]), ["id"], ["v", "w"])
    yield "subquery", CrosstableUDF(a, "c", Subquery(b, [("k", "k")], agg("max", "id", "c")))
    yield "two levels", GroupBy(GroupBy(LeftOuterJoin(a, Rename(b, {"k": "kb"}), ["k"], ["kb"]), ["id_x", "k"], [agg("count", "kb", "n")]), ["n"], [agg("count", alias="m")])


@pytest.mark.parametrize("seed", range(2))
def test_random_predicates(spark, seed):
    """Whatever is asked of the result: pruning keeps it, and the narrowed answer is the eager one."""
    for i, (label, sink) in enumerate(small_pipelines(spark)):
        p = Pipeline(spark, sink)
        rows = p.frame().collect()
        values = {c: sorted({r[c] for r in rows if r[c] is not None})[:5] for c in p.frame().columns}
        f = random_predicate(p.frame().schema, 100 * seed + i, values=values)
        assert verify_pruning(p, f), (label, f.to_sql())
        if label in ("top", "first"):  # rows at their borders can't be told apart by a predicate alone
            continue
        found, want = lineage(p, f), eager_lineage(p, f)
        for t, s in found.sources.items():
            assert same_rows(s.rows, want[t].rows), (label, t, s.status, f.to_sql(), s.predicate.to_sql())


def test_pipeline_reads_a_stored_result(spark, small, tmp_path):
    p = Pipeline(spark, tpch.q3(catalog.tables(small)))
    join = next(n for n in p.nodes if isinstance(n, InnerJoin))
    write_parquet(p.frame(join), f"file://{tmp_path}/join")
    q = p.reading({join: ParquetTable(f"file://{tmp_path}/join", "stored")})
    assert same_rows(p.frame(), q.frame()) and {s.table for s in q.sources} == {"stored", "lineitem"}


def test_dummy_predicate_reaches_every_source(spark, small):
    p = Pipeline(spark, tpch.q10(catalog.tables(small)))
    pushed = push_down(p, schema_predicate(p.frame().schema))
    assert all(pushed[s].predicate.columns() for s in p.sources)


def test_a_fixed_limit_lets_the_row_prune_below_it(spark, small):
    p = Pipeline(spark, tpch.q10(catalog.tables(small)))
    row = p.frame().first()
    pushed = push_down(p, row_predicate(row))
    assert not any("c_custkey" in pushed[s].prune.columns() for s in p.sources)  # below the limit nothing is pruned by the row
    q = without_limits(p, pushed)
    assert not any(isinstance(n, TopN) for n in q.nodes) and q.sources == p.sources
    below = {n.table: x.prune.to_sql() for n, x in push_down(q, row_predicate(row)).items() if n in q.sources}
    assert str(row.c_custkey) in below["customer"] and '"o_custkey" IS NOT DISTINCT FROM' in below["orders"] and row.n_name in below["nation"]
    plan = q.tracked(q.identified({s: push_down(q, row_predicate(row))[s].prune for s in q.sources}))._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"o_custkey#\d+L <=> {row.c_custkey}\)", plan) and "TakeOrdered" not in plan


def test_a_limit_whose_row_is_not_fixed_stays(spark, small):
    p = Pipeline(spark, tpch.q10(catalog.tables(small)))
    f = col("c_custkey") == p.frame().first().c_custkey
    assert without_limits(p, push_down(p, f)) is p
    found, want = lineage(p, f), eager_lineage(p, f)
    for t, s in found.sources.items():
        assert same_rows(s.rows, want[t].rows), t


def test_no_row_below_a_limit_has_no_lineage(spark, small):
    """A row that the query would give but for the limit isn't in the result."""
    p = Pipeline(spark, tpch.q10(catalog.tables(small)))
    top = next(n for n in p.nodes if isinstance(n, TopN))
    beyond = p.frame(top.inputs[0]).exceptAll(p.frame(top)).first()
    assert beyond is not None and set(lineage(p, row_predicate(beyond)).counts().values()) == {0}
