"""The truth of constant predicates, as Spark has it."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import SparkSession

from .expr import And, Cmp, Expr, InSet, IsNull, Lit, Not, Or


def plain(p: Expr) -> bool:
    """Whether p is made of comparisons of constants only, whose truth Python and Spark agree on."""
    if isinstance(p, Lit):
        return not (isinstance(p.value, float) and math.isnan(p.value))
    if isinstance(p, InSet):
        return plain(p.arg) and all(plain(v) if isinstance(v, Expr) else plain(Lit(v)) for v in p.values)
    if isinstance(p, Cmp) and isinstance(p.left, Lit) and isinstance(p.right, Lit):
        kinds = {type(x.value) for x in (p.left, p.right) if x.value is not None}
        return len(kinds - {int, float}) <= (0 if kinds & {int, float} else 1) and plain(p.left) and plain(p.right)
    return isinstance(p, (And, Or, Not, IsNull)) and all(map(plain, p.children()))


def truth(p: Expr) -> bool | None:
    """The value of a predicate without columns: true, false or null.

    Anything but comparisons is asked of Spark, on a frame of one row: its functions have
    their own rules for nulls, rounding, NaN and patterns. If Spark refuses it, that is
    raised here, as it would be in the query.
    """
    if plain(p):
        return p.eval_row({})
    return _asked(repr(p), p) if p.deterministic() else _ask(p)


class _Key(str):
    """Cached by the text of a predicate, which says all of it; carries the predicate along."""


def _asked(text: str, p: Expr) -> bool | None:
    key = _Key(text)
    key.predicate = p
    return _cached(key)


@lru_cache(maxsize=4096)
def _cached(key: _Key) -> bool | None:
    return _ask(key.predicate)


def _ask(p: Expr) -> bool | None:
    return SparkSession.active().sql("SELECT * FROM VALUES (1)").select(p.to_column().cast("boolean")).first()[0]
