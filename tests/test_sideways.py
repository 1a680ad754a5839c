"""Sources reduced by one another: sound on every pipeline, and exact without tracking on a tree of joins."""

from __future__ import annotations

import re

import pytest

from sluice.lineage import eager_lineage, lineage, push_down, same_rows
from sluice.lineage.answer import without_limits
from sluice.lineage.sideways import edges, join_tree, outwards, reduced
from sluice.operators import AntiJoin, DropDuplicate, Filter, GroupBy, InnerJoin, LeftOuterJoin, Rename, Select, SemiJoin, SetItem, TopN, agg
from sluice.operators.base import RID
from sluice.pipeline import Pipeline
from sluice.plans import catalog, operator_queries, tpch
from sluice.predicate import TRUE, col, row_predicate
from sluice.sources import FrameTable

PIPELINES = {**{f"tpch_{k}": v for k, v in tpch.PIPELINES.items()}, "join_suffixes": operator_queries.inner_join_suffixes}


def traced(p, f):
    """(the pipeline that is traced, what the pass asks of it)."""
    pushed = push_down(p, f)
    t = without_limits(p, pushed)
    return t, pushed if t is p else push_down(t, f)


@pytest.mark.parametrize("name", sorted(PIPELINES))
def test_no_reduction_changes_the_rows_asked_for(spark, small, name):
    p = Pipeline(spark, PIPELINES[name](catalog.tables(small)))
    row = p.frame().first()
    if row is None:
        pytest.skip("no row at this size")
    t, pushed = traced(p, row_predicate(row))
    filters = {s: pushed[s].prune for s in t.sources}
    by = outwards(t, filters)
    if not by:
        pytest.skip("no join path leads from a fixed source")
    frames = reduced(t.identified(filters), by)
    made = {}
    for n in t.nodes:
        made[n] = frames[n].drop(RID) if not n.inputs else n.build(*[made[i] for i in n.inputs])
    f = row_predicate(row).to_column()
    assert same_rows(made[t.sink].filter(f), p.frame().filter(f))


def test_every_table_that_a_join_path_leads_to_is_filtered(spark, small):
    for name, make in tpch.PIPELINES.items():
        p = Pipeline(spark, make(catalog.tables(small)))
        row = p.frame().first()
        if row is None:
            continue
        t, pushed = traced(p, row_predicate(row))
        by = outwards(t, {s: pushed[s].prune for s in t.sources})
        filtered = {s for s in t.sources if pushed[s].prune is not TRUE and repr(pushed[s].prune) != repr(TRUE)} | by.keys()
        for e in edges(t):
            for a, b, may in ((e.left, e.right, e.to_right), (e.right, e.left, e.to_left)):
                assert not may or a not in by or b in filtered, (name, a, b)


def test_q10_filters_line_items_by_order_key_and_reads_each_table_once(spark, small):
    p = Pipeline(spark, tpch.q10(catalog.tables(small)))
    f = row_predicate(p.frame().first())
    answer = lineage(p, f, check_exists=False, tables=["lineitem"])
    assert set(answer.sources) == {"lineitem"} and answer["lineitem"].exact
    plan = answer["lineitem"].rows._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "l_orderkey" in plan and "__lineage" not in plan and "__rid" not in plan
    assert len(re.findall("FileScan parquet", plan)) == 4 and re.search(r"PushedFilters: \[[^]]*o_custkey", plan)


def table(spark, name, rows, schema):
    return FrameTable(spark.createDataFrame(rows, schema), name, [schema.split()[0]])


@pytest.fixture(scope="module")
def chain(spark):
    a = table(spark, "a", [(i, i % 3) for i in range(9)], "a int, kind int")
    b = table(spark, "b", [(i, i % 10 if i % 7 else None, i % 4) for i in range(40)], "b int, of_a int, flag int")
    c = table(spark, "c", [(i, i % 50, float(i)) for i in range(90)], "c int, of_b int, v double")
    return a, b, c


def test_a_tree_of_joins_is_exact_without_tracking(spark, chain):
    a, b, c = chain
    j = InnerJoin(InnerJoin(a, Filter(b, col("flag") > 0), ["a"], ["of_a"]), Rename(c, {"of_b": "b"}), ["b"])
    p = Pipeline(spark, GroupBy(SetItem(j, "w", col("v") * 2), ["kind"], [agg("sum", "w", "w")]))
    for row in p.frame().collect():
        f = row_predicate(row)
        assert join_tree(p, push_down(p, f))
        found, want = lineage(p, f), eager_lineage(p, f)
        assert all(s.exact and same_rows(s.rows, want[t].rows) for t, s in found.sources.items())
        assert set(lineage(p, f, tables=["b", "c"]).sources) == {"b", "c"}
    assert lineage(p, col("kind") == 77).counts() == {"a": 0, "b": 0, "c": 0}


@pytest.mark.parametrize("made", [
    lambda a, b, c: GroupBy(LeftOuterJoin(a, b, ["a"], ["of_a"]), ["kind"], [agg("count", "b", "n")]),
    lambda a, b, c: GroupBy(InnerJoin(a, TopN(b, 9, ["flag"]), ["a"], ["of_a"]), ["kind"], [agg("count", "b", "n")]),
    lambda a, b, c: GroupBy(InnerJoin(a, Select(DropDuplicate(b, ["flag"]), ["of_a", "flag"]), ["a"], ["of_a"]), ["kind"], [agg("count", "flag", "n")]),
    lambda a, b, c: GroupBy(Filter(InnerJoin(a, b, ["a"], ["of_a"]), col("flag") > col("kind")), ["kind"], [agg("count", "b", "n")]),
    lambda a, b, c: GroupBy(SemiJoin(InnerJoin(a, b, ["a"], ["of_a"]), c, ["b"], ["of_b"]), ["kind"], [agg("count", "b", "n")]),
    lambda a, b, c: GroupBy(AntiJoin(InnerJoin(a, b, ["a"], ["of_a"]), c, ["b"], ["of_b"]), ["kind"], [agg("count", "b", "n")]),
    lambda a, b, c: GroupBy(InnerJoin(InnerJoin(b, c, ["b"], ["of_b"]), Rename(b, {"b": "b2", "flag": "flag2", "of_a": "of2"}), ["of_a"], ["of2"]), ["flag"], [agg("count", "c", "n")]),
    lambda a, b, c: GroupBy(InnerJoin(a, GroupBy(InnerJoin(b, c, ["b"], ["of_b"]), ["of_a"], [agg("sum", "v", "v")]), ["a"], ["of_a"]), ["kind"], [agg("max", "v", "v")]),
], ids=["left", "limit", "duplicates", "two sources", "semi", "anti", "self", "inner group"])
def test_other_shapes_agree_with_eager_tracking(spark, chain, made):
    p = Pipeline(spark, made(*chain))
    for row in p.frame().collect():
        found, want = lineage(p, row_predicate(row)), eager_lineage(p, row_predicate(row))
        assert all(s.exact and same_rows(s.rows, want[t].rows) for t, s in found.sources.items()), row
