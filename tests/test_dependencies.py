"""Functional dependencies hold on every node, and what the pass calls exact is."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluice.lineage import eager_lineage, lineage, push_down, same_rows
from sluice.lineage.dependencies import closure, dependencies
from sluice.operators import Filter, GroupBy, InnerJoin, LeftOuterJoin, Rename, Select, SemiJoin, SetItem, Status, agg
from sluice.pipeline import Pipeline
from sluice.plans import catalog, lineage_queries, operator_queries, tpch
from sluice.predicate import col, row_predicate
from sluice.sources import FrameTable

PIPELINES = {**{f"tpch_{k}": tpch.PIPELINES[k] for k in ("q3", "q10", "q18")}, "joined": operator_queries.inner_join_suffixes, "dependent": lineage_queries.dependent_group}


def test_closure():
    deps = {(frozenset("a"), frozenset("b")), (frozenset("bc"), frozenset("d")), (frozenset(), frozenset("z"))}
    assert closure("a", deps) == frozenset("abz") and closure("ac", deps) == frozenset("abcdz") and closure("", deps) == frozenset("z")


@pytest.mark.parametrize("name", sorted(PIPELINES))
def test_dependencies_hold_on_the_data(spark, small, name):
    p = Pipeline(spark, PIPELINES[name](catalog.tables(small)))
    tests = {}
    for n, deps in dependencies(p).items():
        if not n.inputs:
            continue
        for x, y in deps:
            tests.setdefault(n, set()).update((x, c) for c in y - x)
    for n, pairs in tests.items():
        pairs = sorted(pairs, key=lambda t: (sorted(t[0]), t[1]))
        df = p.frame(n)
        for x in {t[0] for t in pairs}:
            counts = df.groupBy(*[f"`{c}`" for c in sorted(x)]).agg(*[F.count_distinct(F.struct(F.col(f"`{c}`"))).alias(f"n{i}") for i, (w, c) in enumerate(pairs) if w == x])
            worst = counts.agg(*[F.max(c) for c in counts.columns if c.startswith("n") and c[1:].isdigit() and c not in x]).first()
            assert all(v is None or v == 1 for v in worst), (n, x)


@pytest.fixture(scope="module")
def made(spark):
    table = lambda name, rows, schema: FrameTable(spark.createDataFrame(rows, schema), name, [schema.split()[0]])
    rng = random.Random(11)
    a = table("a", [(i, i % 3, i % 2) for i in range(9)], "a int, kind int, two int")
    b = table("b", [(i, rng.choice([None, *range(11)]), i % 4) for i in range(40)], "b int, of_a int, flag int")
    c = table("c", [(i, rng.randrange(50), i % 5) for i in range(90)], "c int, of_b int, v int")
    ab = InnerJoin(a, b, ["a"], ["of_a"])
    return {
        "group of joined": GroupBy(ab, ["of_a", "kind", "two"], [agg("count", alias="n")]),
        "computed": GroupBy(SetItem(ab, "twice", col("kind") * 2), ["a", "twice", "flag"], [agg("count", alias="n")]),
        "chain": GroupBy(InnerJoin(ab, c, ["b"], ["of_b"]), ["b", "a", "kind"], [agg("sum", "v", "s")]),
        "left": GroupBy(LeftOuterJoin(a, Select(ab2(b, c), ["of_a", "v"]), ["a"], ["of_a"]), ["a", "kind", "two"], [agg("sum", "v", "s")]),
        "semi": SemiJoin(ab, Rename(c, {"c": "c2"}), ["b"], ["of_b"]),
        "constant": GroupBy(InnerJoin(Filter(a, col("kind") == 1), b, ["a"], ["of_a"]), ["a", "kind"], [agg("max", "b", "m")]),
        "two sided": Filter(InnerJoin(ab, c, ["b"], ["of_b"]), col("kind") <= col("v")),
    }


def ab2(b, c):
    return InnerJoin(b, c, ["b"], ["of_b"])


NAMES = ["group of joined", "computed", "chain", "left", "semi", "constant", "two sided"]


@pytest.mark.parametrize("name", NAMES)
def test_what_is_called_exact_is_exact(spark, made, name):
    """Some columns of a row are given, chosen at random: no predicate that is called exact selects more or less than the lineage."""
    p, rng, exact = Pipeline(spark, made[name]), random.Random(name), 0
    rows, columns = p.frame().collect(), p.frame().columns
    for _ in range(6):
        f = row_predicate(rng.choice(rows), sorted(rng.sample(columns, rng.randint(1, len(columns)))))
        found, want = lineage(p, f, "pushdown"), eager_lineage(p, f)
        for table, s in found.sources.items():
            if s.exact:
                exact += 1
                assert same_rows(s.rows, want[table].rows), (table, f.to_sql(), s.predicate.to_sql())
            else:
                assert s.rows.join(want[table].rows, [table]).count() == want[table].rows.count()
    assert exact


def test_a_dependent_group_is_exact(spark, small):
    p = Pipeline(spark, lineage_queries.dependent_group(catalog.tables(small)))
    row = p.frame().first()
    pushed = push_down(p, row_predicate(row, ["o_custkey", "n", "last"]))
    assert {s.table: pushed[s].status for s in p.sources} == {"customer": Status.EXACT, "orders": Status.EXACT}
    loose = push_down(p, row_predicate(row, ["c_nationkey", "n"]))
    assert all(loose[s].status == Status.SUPERSET for s in p.sources)
