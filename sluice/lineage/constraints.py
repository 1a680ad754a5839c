"""What is known of a table beyond its schema, and how it simplifies a predicate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import name
from ..predicate import Expr, all_of, pinned, split_and


@dataclass(frozen=True)
class FunctionalDependency:
    """The column is `value`, an expression of other columns."""

    column: str
    value: Expr


@dataclass
class Constraints:
    rows: int = 0
    unique: set[frozenset[str]] = field(default_factory=set)
    #: Of columns with few values, the values; of others, least and greatest.
    domain: dict[str, tuple[Any, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[Any, Any]] = field(default_factory=dict)
    dependencies: list[FunctionalDependency] = field(default_factory=list)

    @property
    def non_empty(self) -> bool:
        return self.rows > 0


def measure(df: DataFrame, columns: Sequence[str] | None = None, few: int = 10) -> Constraints:
    """Unique columns, small domains and ranges, in one pass for counts and ranges and one for the small domains."""
    columns = list(columns or df.columns)
    parts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        parts += [F.count_distinct(name(c)).alias(f"d{i}"), F.min(name(c)).alias(f"a{i}"), F.max(name(c)).alias(f"b{i}"), F.count(name(c)).alias(f"c{i}")]
    r = df.agg(*parts).first()
    out = Constraints(rows=r.n)
    small = []
    for i, c in enumerate(columns):
        if r[f"d{i}"] == r[f"c{i}"] == r.n:
            out.unique.add(frozenset({c}))
        if r[f"d{i}"] < few:
            small.append(c)
        else:
            out.ranges[c] = (r[f"a{i}"], r[f"b{i}"])
    if small:  # fewer than `few` values each
        s = df.agg(*[F.sort_array(F.collect_set(name(c))).alias(c) for c in small]).first()
        out.domain = {c: tuple(s[c]) for c in small}
    return out


def drop_by_key(f: Expr, keys: Iterable[frozenset[str]], unwanted: Iterable[str]) -> Expr:
    """f without atoms on unwanted columns, if the rest fixes a unique key: then they decide nothing more."""
    unwanted = set(unwanted)
    rest = [p for p in split_and(f) if not p.columns() & unwanted]
    return all_of(rest) if any(k <= pinned(all_of(rest)) for k in keys) else f


def replace_by_dependency(f: Expr, dependencies: Iterable[FunctionalDependency]) -> Expr:
    """f with columns that follow from others put in terms of those."""
    return f.substitute({d.column: d.value for d in dependencies})
