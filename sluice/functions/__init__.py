"""Scalar functions usable in expressions; register adds more."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ..predicate.expr import FUNCTIONS, Call, Expr, _greatest, _least, lit


def register(name: str, column: Callable, python: Callable, sql: str) -> None:
    """Make name callable in expressions. sql: with {0}, {1} for the arguments, or {all}."""
    FUNCTIONS[name] = (column, python, sql)


def call(name: str, *args) -> Expr:
    if name not in FUNCTIONS:
        raise KeyError(f"no function {name}; functions.register adds one")
    return Call(name, tuple(lit(a) for a in args))


def half_up(v, digits: int = 0):
    """Rounded to so many digits of its shortest decimal form, halves away from zero."""
    if isinstance(v, float) and not math.isfinite(v):
        return v
    exact = Decimal(repr(v)) if isinstance(v, float) else Decimal(v)
    out = exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    return float(out) if isinstance(v, float) else int(out) if isinstance(v, int) else out


def part(s: str, start: int, n: int) -> str:
    """n characters of s from start, which counts from 1, or, if negative, from the end; 0 is 1."""
    low = start - 1 if start > 0 else start + len(s) if start < 0 else 0
    return s[max(0, low) : max(0, low + n)]


register("year", F.year, lambda d: d.year, "CAST(YEAR({0}) AS INTEGER)")
register("month", F.month, lambda d: d.month, "CAST(MONTH({0}) AS INTEGER)")
register("to_date", F.to_date, lambda d: d.date() if hasattr(d, "date") else d, "CAST({0} AS DATE)")
register("substring", F.substring, part, "SUBSTRING({all})")
register("upper", F.upper, str.upper, "UPPER({0})")
register("lower", F.lower, str.lower, "LOWER({0})")
register("trim", F.trim, lambda s: s.strip(" "), "TRIM({0})")
register("length", F.length, len, "LENGTH({0})")
register("abs", F.abs, abs, "ABS({0})")
register("round", F.round, half_up, "ROUND({all})")
register("concat", F.concat, lambda *s: "".join(s), "CONCAT({all})")
register("coalesce", F.coalesce, lambda *v: next((x for x in v if x is not None), None), "COALESCE({all})")
register("least", F.least, _least, "LEAST({all})")
register("greatest", F.greatest, _greatest, "GREATEST({all})")
register("replace", lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)), lambda s, a, b: s.replace(a, b), "REPLACE({all})")
register("split_part", lambda c, by, i: F.get(F.split(c, "\\Q" + by + "\\E"), i - 1), lambda s, by, i: (s.split(by) + [None] * i)[i - 1], "NULLIF(SPLIT_PART({all}), '')")
register("regexp_extract", lambda c, p, i: F.regexp_extract(c, p, i), lambda s, p, i: (m.group(i) or "") if (m := __import__("re").search(p, s)) else "", "REGEXP_EXTRACT({all})")
