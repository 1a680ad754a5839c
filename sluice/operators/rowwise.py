"""Operators that treat each row alone; predicates go through them by substitution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..predicate import TRUE, Call, Case, Cast, Expr, Field, Lit, And, all_of, col, lit, simplify
from .base import LINEAGE, Node, Push, Status, carried, data_columns, name


class RowWise(Node):
    """Output columns are expressions of a row's columns."""

    def expressions(self) -> Mapping[str, Expr]:
        """The made or overwritten columns, in terms of the input."""
        return {}

    def updated(self) -> frozenset[str]:
        return frozenset(self.expressions())

    def comes_from(self, column, columns):
        made = self.expressions().get(column)
        if made is None:
            return (0, column, True) if column in columns[0] else None
        return (0, made.name, True) if isinstance(made, Field) else None

    def build(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: e.to_column() for c, e in self.expressions().items()})

    def push(self, f: Expr, columns, out) -> list[Push]:
        made = self.expressions()
        if any(not made[c].deterministic() for c in f.columns() & made.keys()):
            return [Push(TRUE, Status.BLOCKED, f"{self!r}: a predicate on a function that is not deterministic")]
        return [Push(simplify(f.substitute(made)))]


class Filter(RowWise):
    """Rows for which the condition is true."""

    def __init__(self, dep: Node, condition: Expr):
        super().__init__(dep)
        self.condition = condition

    def build(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition.to_column())

    def push(self, f, columns, out):
        return [Push(simplify(And(self.condition, f)))]


class DropNA(Filter):
    """Rows without a null in any of the columns."""

    def __init__(self, dep: Node, cols: Sequence[str]):
        super().__init__(dep, all_of(col(c).is_not_null() for c in cols))


class SetItem(RowWise):
    """A derived column; one of that name is overwritten. apply: an expression, or Opaque for a Python function."""

    def __init__(self, dep: Node, new_col: str, apply: Expr | Any):
        super().__init__(dep)
        self.new_col, self.apply = new_col, lit(apply)

    def expressions(self):
        return {self.new_col: self.apply}


class FillNA(SetItem):
    """Nulls of a column replaced by a constant."""

    def __init__(self, dep: Node, column: str, value: Any):
        super().__init__(dep, column, Call("coalesce", (Field(column), Lit(value))))


class ChangeType(SetItem):
    """A column cast to a type; what can't be converted becomes null. new_col may be the column itself."""

    def __init__(self, dep: Node, target_type: str, orig_col: str, new_col: str | None = None):
        kinds = {"int": "bigint", "float": "double", "str": "string", "datetime": "timestamp_ntz"}
        super().__init__(dep, new_col or orig_col, Cast(Field(orig_col), kinds.get(target_type, target_type)))


class Split(RowWise):
    """A string column split into new ones; all other columns stay.

    by: a delimiter, the pieces in order (missing ones null); regex: the groups of its
    first match (empty if there is none).
    """

    def __init__(self, dep: Node, column: str, new_cols: Sequence[str], by: str | None = None, regex: str | None = None):
        super().__init__(dep)
        if (by is None) == (regex is None):
            raise ValueError("give either by or regex")
        self.column, self.new_cols, self.by, self.regex = column, list(new_cols), by, regex

    def expressions(self):
        fn, pattern = ("split_part", self.by) if self.by is not None else ("regexp_extract", self.regex)
        return {c: Call(fn, (Field(self.column), Lit(pattern), Lit(i))) for i, c in enumerate(self.new_cols, 1)}


class GetDummies(RowWise):
    """For each value of a column, a column `<column>_<value>` that is 1 in its rows and 0 in others; the column itself goes."""

    def __init__(self, dep: Node, values: Mapping[str, Sequence[Any]]):
        super().__init__(dep)
        self.values = {c: list(v) for c, v in values.items()}

    def expressions(self):
        return {f"{c}_{v}": Case(((Field(c) == v, Lit(1)),), Lit(0)) for c, vs in self.values.items() for v in vs}

    def build(self, df):
        return super().build(df).drop(*self.values)


class Rename(RowWise):
    """Columns renamed, all at once, so two may swap names."""

    def __init__(self, dep: Node, names: Mapping[str, str]):
        super().__init__(dep)
        self.names = dict(names)

    def expressions(self):
        return {new: Field(old) for old, new in self.names.items()}

    def build(self, df):
        return df.select(*[name(c).alias(self.names.get(c, c)) for c in df.columns])

    def keys(self, keys, columns):
        return {frozenset(self.names.get(c, c) for c in k) for k in keys[0]}


class Copy(RowWise):
    """The same rows."""

    def build(self, df):
        return df


class Select(RowWise):
    """The listed columns only, in that order."""

    def __init__(self, dep: Node, cols: Sequence[str]):
        super().__init__(dep)
        self.cols = list(cols)

    def build(self, df):
        return df.select(*[name(c) for c in self.cols], *carried(df))

    def keys(self, keys, columns):
        return {k for k in keys[0] if k <= set(self.cols)}


class DropColumns(RowWise):
    """All but the listed columns."""

    def __init__(self, dep: Node, cols: Sequence[str]):
        super().__init__(dep)
        self.cols = list(cols)

    def build(self, df):
        return df.select(*[name(c) for c in data_columns(df) if c not in self.cols], *carried(df))

    def keys(self, keys, columns):
        return {k for k in keys[0] if not k & set(self.cols)}


__all__ = ["ChangeType", "Copy", "DropColumns", "DropNA", "F", "FillNA", "Filter", "GetDummies", "LINEAGE", "Rename", "RowWise", "Select", "SetItem", "Split"]
