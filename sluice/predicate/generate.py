"""Predicates made from a schema, for tests and for trying a pipeline out."""

from __future__ import annotations

import datetime as dt
import random
from typing import Any

from pyspark.sql import types as T

from .expr import And, Cmp, Expr, Field, InSet, IsNull, Lit, Not, Or, all_of

_DUMMIES: list[tuple[type, list[Any]]] = [
    (T.BooleanType, [True, False]), (T.IntegralType, [0, 1, 2, 5, 10]), (T.FractionalType, [0.0, 0.5, 10.0, 1000.0]), (T.StringType, ["a", "b", "M"]),
    (T.DateType, [dt.date(1996, 1, 1), dt.date(1998, 6, 1)]), (T.TimestampNTZType, [dt.datetime(1996, 1, 1), dt.datetime(1998, 6, 1)]), (T.TimestampType, [dt.datetime(1996, 1, 1)]),
]


def dummies(kind: T.DataType) -> list[Any]:
    """Some values of a type; none for types that predicates don't compare."""
    return next((v for t, v in _DUMMIES if isinstance(kind, t)), [])


def schema_predicate(schema: T.StructType) -> Expr:
    """The predicate of a row of dummy values: what can be said of a pipeline before it has run."""
    return all_of(Cmp("<=>", Field(f.name), Lit(v[0])) for f in schema if (v := dummies(f.dataType)))


def random_predicate(schema: T.StructType, seed: int, depth: int = 3, values: dict[str, list[Any]] | None = None) -> Expr:
    """A predicate of random comparisons under AND, OR and NOT. values: for columns, what to compare with."""
    rng = random.Random(seed)
    fields = [(f.name, (values or {}).get(f.name) or dummies(f.dataType)) for f in schema]
    fields = [(n, v) for n, v in fields if v]

    def one(left: int) -> Expr:
        if left and rng.random() < 0.6:
            kind = rng.choice(("and", "or", "not"))
            return Not(one(left - 1), rng.random() < 0.5) if kind == "not" else (And if kind == "and" else Or)(one(left - 1), one(left - 1))
        name, v = rng.choice(fields)
        kind = rng.choice(("==", "!=", "<", "<=", ">", ">=", "<=>", "in", "null"))
        if kind == "in":
            return InSet(Field(name), tuple(rng.sample(v, min(2, len(v)))))
        return IsNull(Field(name)) if kind == "null" else Cmp(kind, Field(name), Lit(rng.choice(v)))

    return one(depth)
