"""Joins along an order against plain Python, and what their lineage is."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from sluice.lineage import eager_lineage, lineage, same_rows
from sluice.operators import AsOfJoin, CrossJoin, Filter, InnerJoin, IntervalJoin
from sluice.pipeline import Pipeline
from sluice.plans import catalog, operator_queries
from sluice.predicate import col, row_predicate
from sluice.sources import FrameTable


def table(spark, name, rows, schema):
    return FrameTable(spark.createDataFrame(rows, schema), name, [schema.split()[0]])


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, 0.0, -0.0, math.nan, math.inf, 5e-324, -1e300, rng.uniform(-50, 50), float(rng.randint(-9, 9)), rng.uniform(-1e12, 1e12)])
    left = [(i, rng.choice([None, 1, 2]), value()) for i in range(150)]
    right = []
    for i in range(150):
        low = value()
        high = rng.choice([None, low, math.inf, None if low is None else low + rng.choice([1e-9, 0.5, 3, 40, 1e6, 1e300, -1])])
        right.append((i, rng.choice([None, 1, 2]), low, high))
    return left, right


@pytest.mark.parametrize(("by", "closed"), [(False, True), (True, False)])
def test_intervals_of_every_width(spark, points, by, closed):
    left, right = points
    l, r = table(spark, "l", left, "l int, k int, x double"), table(spark, "r", right, "r int, k int, low double, high double")
    p = Pipeline(spark, IntervalJoin(l, r, "x", "low", "high", [("k", "k")] if by else [], closed))
    real = lambda *v: all(x is not None and x == x for x in v)
    want = sorted((a, b) for a, k, x in left for b, m, lo, hi in right if real(x, lo, hi) and (not by or (k is not None and k == m)) and lo <= x and (x <= hi if closed else x < hi))
    assert sorted((x.l, x.r) for x in p.frame().collect()) == want and want


def test_intervals_of_days_and_times(spark):
    day = dt.date(2024, 3, 31)
    l = table(spark, "l", [(i, day + dt.timedelta(days=i)) for i in range(-3, 4)], "l int, d date")
    r = table(spark, "r", [(1, day, day), (2, day - dt.timedelta(days=2), day + dt.timedelta(days=1)), (3, day, day - dt.timedelta(days=1))], "r int, lo date, hi date")
    assert sorted((x.r, x.l) for x in Pipeline(spark, IntervalJoin(l, r, "d", "lo", "hi")).frame().collect()) == [(1, 0), (2, -2), (2, -1), (2, 0), (2, 1)]
    at = [dt.datetime(2024, 3, 31, h, m) for h in range(4) for m in (0, 30)]  # a clock changes in many zones
    l = table(spark, "l", list(enumerate(at)), "l int, t timestamp_ntz")
    r = table(spark, "r", [(1, at[3], at[6])], "r int, lo timestamp_ntz, hi timestamp_ntz")
    assert sorted(x.l for x in Pipeline(spark, IntervalJoin(l, r, "t", "lo", "hi")).frame().collect()) == [3, 4, 5, 6]
    with pytest.raises(TypeError):
        Pipeline(spark, IntervalJoin(table(spark, "l", [(1, "a")], "l int, s string"), r, "s", "lo", "hi")).frame()


def test_an_interval_join_is_an_equi_join(spark, small):
    plan = Pipeline(spark, operator_queries.interval_join(catalog.tables(small))).frame()._jdf.queryExecution().executedPlan().toString()
    # The only nested loop is over the one row of widths.
    assert plan.count("BroadcastNestedLoopJoin Inner") <= 1 and ("BroadcastHashJoin" in plan or "SortMergeJoin" in plan)


@pytest.mark.parametrize(("strict", "by", "ranges"), [(False, True, 1), (False, True, 7), (True, True, 7), (True, False, 7), (False, False, 16)])
def test_as_of_whatever_the_ranges(spark, strict, by, ranges):
    rng = random.Random(ranges)
    key = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3])  # noqa: E731 -- one key holds most rows
    left = [(i, key(), rng.choice([None, *range(40)])) for i in range(200)]
    right = [(i, key(), rng.choice([None, *range(0, 40, 3)]), rng.randint(0, 3)) for i in range(60)]
    l, r = table(spark, "l", left, "l int, k int, t int"), table(spark, "r", right, "r int, k int, u int, v int")
    p = Pipeline(spark, AsOfJoin(l, r, "t", "u", [("k", "k")] if by else [], strict, ranges))
    want = {}
    for a, k, t in left:
        met = [(u, b) for b, m, u, v in right if t is not None and u is not None and (not by or (k is not None and k == m)) and (u < t if strict else u <= t)]
        want[a] = max(met)[1] if met else None  # the last of one time by all columns, of which the first is the key
    assert {x.l: x.r for x in p.frame().collect()} == want


def test_as_of_over_no_rows(spark):
    l, r = table(spark, "l", [(1, 5)], "l int, t int"), table(spark, "r", [], "r int, t int")
    assert [tuple(x) for x in Pipeline(spark, AsOfJoin(l, r, "t", "t")).frame().collect()] == [(1, 5, None, None)]
    assert Pipeline(spark, AsOfJoin(r, l, "t", "t")).frame().collect() == []


@pytest.mark.parametrize("kind", ["interval", "as of"])
def test_lineage_of_rows_and_parts_of_rows(spark, kind):
    rng = random.Random(kind)
    l = table(spark, "l", [(i, rng.randint(1, 3), rng.randint(0, 20)) for i in range(40)], "l int, k int, x int")
    r = table(spark, "r", [(i, rng.randint(1, 3), (lo := rng.randint(0, 20)), lo + rng.randint(0, 5)) for i in range(40)], "r int, k int, low int, high int")
    p = Pipeline(spark, IntervalJoin(l, r, "x", "low", "high", [("k", "k")]) if kind == "interval" else AsOfJoin(l, r, "x", "low", [("k", "k")], ranges=4))
    rows, exact = p.frame().collect(), 0
    for columns in (["l", "k", "x"], ["k", "low", "high"], ["r"], p.frame().columns):
        f = row_predicate(rng.choice([x for x in rows if x.r is not None]), columns)
        want, pushed, found = eager_lineage(p, f), lineage(p, f, "pushdown"), lineage(p, f)
        for t in ("l", "r"):
            assert same_rows(found[t].rows, want[t].rows), (t, columns)
            exact += pushed[t].exact
            assert not pushed[t].exact or same_rows(pushed[t].rows, want[t].rows), (t, columns)
    assert exact >= 2


@pytest.mark.parametrize("cross", [False, True])
def test_an_atom_on_both_sides_of_a_join_is_not_lost(spark, cross):
    l, r = table(spark, "l", [(1, 3, 1), (2, 3, 9)], "l int, k int, x int"), table(spark, "r", [(1, 3, 5), (2, 3, 0)], "r int, m int, y int")
    p = Pipeline(spark, Filter(CrossJoin(l, r) if cross else InnerJoin(l, r, ["k"], ["m"]), col("x") < col("y")))
    for f in (col("k") == 3, (col("k") == 3) & (col("x") == 1), (col("m") == 3) & (col("y") > 0)):
        found, want = lineage(p, f, "pushdown"), eager_lineage(p, f)
        assert all(not found[t].exact or same_rows(found[t].rows, want[t].rows) for t in ("l", "r")), f.to_sql()
        assert all(same_rows(lineage(p, f)[t].rows, want[t].rows) for t in ("l", "r"))
    given = lineage(p, (col("k") == 3) & (col("x") == 1), "pushdown")
    assert cross or (given["r"].exact and given["l"].exact)
