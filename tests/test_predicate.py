"""Expressions: Spark, Python and SQL agree; rewriting is sound on every small row."""

from __future__ import annotations

import itertools

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from sluice.functions import call
from sluice.predicate import And, Arith, Between, Case, Cast, Cmp, Contains, InSet, InTuples, IsNull, Like, Lit, Not, Or, all_of, any_of, col, implied_pins, lit, nnf, pinned, row_predicate, simplify, truth, weaken

DOMAIN = {"a": [None, 0, 1], "b": [None, 0, 1], "s": [None, "a", "ab"]}
ROWS = [dict(zip(DOMAIN, v, strict=True)) for v in itertools.product(*DOMAIN.values())]

atoms = st.sampled_from([
    col("a") == 1, col("a") != col("b"), col("a") <= 0, col("b") > 0, IsNull(col("a")), col("s").contains("b"), Like(col("s"), "a%"), InSet(col("b"), (0, None)), Cmp("<=>", col("a"), Lit(None)),
    InTuples((col("a"), col("b")), ((1, None), (0, 1))), Between(col("a"), lit(0), lit(0)), Contains(Lit("xab"), col("s")), lit(True), lit(False)])
predicates = st.recursive(atoms, lambda p: st.one_of(st.builds(And, p, p), st.builds(Or, p, p), st.builds(Not, p), st.builds(lambda x: Not(x, True), p)), max_leaves=6)


@settings(max_examples=300, deadline=None)
@given(predicates)
def test_normal_form_and_simplification_keep_the_truth(p):
    for r in ROWS:
        assert (p.eval_row(r) is True) == (nnf(p).eval_row(r) is True), (r, p.to_sql())
        assert (p.eval_row(r) is True) == (simplify(p).eval_row(r) is True)


@settings(max_examples=300, deadline=None)
@given(predicates, st.sets(st.sampled_from("abs")))
def test_weakening_is_implied_and_forgets_the_columns(p, gone):
    w = weaken(p, gone)
    assert not w.columns() & gone
    assert all(w.eval_row(r) is True for r in ROWS if p.eval_row(r) is True), p.to_sql()


@settings(max_examples=200, deadline=None)
@given(predicates)
def test_pinned_columns_have_one_value_or_one_tuple_list(p):
    fixed = sorted(pinned(p) - {"s"})
    values = {tuple(r[c] for c in fixed) for r in ROWS if p.eval_row(r) is True}
    assert not fixed or len(values) <= 2


def test_spark_and_sql_give_what_python_gives(spark):
    exprs = [
        col("a") + col("b") * 2, col("a") / col("b"), Case(((col("a") > col("b"), lit("x")),), col("s")), Cast(col("s"), "int"), Not(col("a") == 1, True), ~(col("a") == 1), InSet(col("a"), (1,)),
        InTuples((col("a"), col("s")), ((None, "a"), (1, "ab"))), Like(col("s"), "_b"), col("s").contains("b"), call("upper", col("s")), call("coalesce", col("a"), col("b"), -1), call("length", col("s")),
        Cmp("<=>", col("a"), col("b")), IsNull(col("s")), Between(col("a"), lit(0), col("b")), call("split_part", col("s"), "b", 1), call("substring", col("s"), 1, 1)]
    df = spark.createDataFrame([Row(**r) for r in ROWS], "a int, b int, s string")
    got = df.select(*[e.to_column().alias(f"c{i}") for i, e in enumerate(exprs)], "a", "b", "s").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a INT, b INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [tuple(r.values()) for r in ROWS])
    sql = {(r[-3:]): r[:-3] for r in con.sql(f"SELECT {', '.join(e.to_sql() for e in exprs)}, a, b, s FROM t").fetchall()}
    for g in got:
        row = {"a": g.a, "b": g.b, "s": g.s}
        for i, e in enumerate(exprs):
            assert g[f"c{i}"] == pytest.approx(e.eval_row(row)) if g[f"c{i}"] is not None else e.eval_row(row) is None, (e.to_sql(), row)
            if "SPLIT_PART" not in e.to_sql():
                assert sql[(g.a, g.b, g.s)][i] == pytest.approx(g[f"c{i}"]) if g[f"c{i}"] is not None else sql[(g.a, g.b, g.s)][i] is None, (e.to_sql(), row)


@pytest.fixture(scope="module")
def odd_values(spark):
    numbers, texts = [None, -2.5, -0.5, 0.0, 0.5, 1.5, 2.5, 2.675, float("nan"), float("inf")], [None, "", " a ", "abc", "ba,b", "\u00e9x"]
    rows = [{"x": x, "y": y, "n": n, "s": s} for x in numbers for y in numbers for n, s in zip([None, -15, 25, 3, 0, 7], texts, strict=True)]
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], "x double, y double, n int, s string")


def test_the_evaluator_gives_what_spark_gives(odd_values):
    x, y, n, s = col("x"), col("y"), col("n"), col("s")
    exprs = [
        call("least", x, y, 1.0), call("greatest", x, y), call("round", x, 0), call("round", x, 1), call("round", n, -1), call("coalesce", x, y, 3.0), call("abs", x), Arith("min", x, y), Arith("max", x, y), x / y,
        x < y, x <= y, x == y, x != y, x > y, Cmp("<=>", x, y), Between(x, y, lit(2.0)), InSet(x, (2.5, 0.0)), call("length", s), call("upper", s), call("trim", s), call("concat", s, s),
        call("substring", s, 0, 2), call("substring", s, 2, 1), call("substring", s, -2, 2), call("substring", s, -9, 8), call("replace", s, "b", ""), call("split_part", s, ",", 2), call("regexp_extract", s, "(b)(,?)", 2), Cast(s, "int"), Like(s, "%b_"), s.contains("b"), IsNull(s)]
    rows, df = odd_values
    out = df.select("*", *[e.to_column().alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    for row, got in zip(rows, out, strict=True):
        for i, e in enumerate(exprs):
            v, w = e.eval_row(row), got[f"c{i}"]
            assert v == w or (v != v and w != w), (e, row, v, w)


def test_constants_are_folded_as_spark_folds_them(spark):
    assert truth(call("round", lit(2.5), 0) == 3.0) is True and truth(call("least", Lit(None), 5.0) == 5.0) is True and truth(call("greatest", Lit(None), 5.0) == 5.0) is True
    assert truth(Lit(float("nan")) == float("nan")) is True and truth(Lit(None) == 1) is None and truth(InSet(lit(1), (2, None))) is None and truth(lit("1") == 1) is True


def test_substitution_is_simultaneous():
    p = (col("a") == 1) & (col("b") == 2)
    assert p.substitute({"a": col("b"), "b": col("a")}).to_sql() == '(("b" = 1) AND ("a" = 2))'


def test_nothing_at_all():
    assert all_of([]).eval_row({}) is True and any_of([]).eval_row({}) is False


def test_keys_carry_over_a_join():
    p = row_predicate({"x": 1, "y": 2})
    assert implied_pins(p, [("x", "u"), ("y", "v")]).to_sql() == '(("u" IS NOT DISTINCT FROM 1) AND ("v" IS NOT DISTINCT FROM 2))'


def test_truth_value_is_refused():
    with pytest.raises(TypeError):
        bool(col("a") == 1)
