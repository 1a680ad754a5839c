"""Operators that turn columns into rows and back, and that order rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..predicate import FALSE, TRUE, And, Expr, Field, InSet, Lit, any_of, pinned, simplify, weaken
from .aggregates import _FUNCTIONS
from .base import LINEAGE, Node, Push, Status, carried, data_columns, gathered, members_by, name


class Pivot(Node):
    """A row for each value of index_cols, a column for each of header_values with fn of value_col.

    fn None: the single value of each cell; more than one is an error at run time.
    """

    def __init__(self, dep: Node, index_cols: Sequence[str], header_col: str, value_col: str, header_values: Sequence[Any], fn: str | None = "sum"):
        super().__init__(dep)
        self.index, self.header, self.value, self.values, self.fn = list(index_cols), header_col, value_col, list(header_values), fn

    def _value(self):
        v = name(self.value)
        if self.fn:
            return _FUNCTIONS[self.fn](v)
        return F.when(F.count(v) > 1, F.raise_error(F.lit("pivot: more than one value in a cell"))).otherwise(F.max(v))

    def build(self, df):
        # One conditional aggregate for each value, in one pass over the groups.
        of = {h: F.when(name(self.header) == F.lit(h), name(self.value)) for h in self.values}
        cells = []
        for h in self.values:
            c = of[h]
            cells.append((_FUNCTIONS[self.fn](c) if self.fn else F.when(F.count(c) > 1, F.raise_error(F.lit("pivot: more than one value in a cell"))).otherwise(F.max(c))).alias(str(h)))
        if self.fn == "count":  # an empty cell has no count
            cells = [F.when(F.count(of[h]) > 0, F.count(of[h])).alias(str(h)) for h in self.values]
        return df.groupBy(*[name(c) for c in self.index]).agg(*cells, *([gathered()] if LINEAGE in df.columns else []))

    def track(self, df):
        used = df.filter(name(self.header).isin(self.values))
        lineage = used.groupBy(*[name(c).alias(f"__k{i}") for i, c in enumerate(self.index)]).agg(gathered())
        out = self.build(df.drop(LINEAGE))
        test = F.lit(True)
        for i, c in enumerate(self.index):
            test = test & name(c).eqNullSafe(F.col(f"__k{i}"))
        none = F.array().cast("array<struct<source:string,rid:string>>")
        return out.join(lineage, test, "left").select(*[name(c) for c in data_columns(out)], F.coalesce(F.col(LINEAGE), none).alias(LINEAGE))

    def refer(self, refs, df):
        out = self.build(df.drop(LINEAGE))
        used = df.filter(name(self.header).isin(self.values))
        return out.withColumn(LINEAGE, refs.to(out, self.index, members_by(used, self.index)))

    def updated(self):
        return frozenset(str(h) for h in self.values)

    def push(self, f, columns, out):
        key = weaken(f, set(out) - set(self.index))
        exact = set(self.index) <= pinned(f) or f.columns() <= set(self.index)
        return [Push(simplify(And(key, InSet(Field(self.header), tuple(self.values)))), Status.EXACT if exact else Status.SUPERSET, "" if exact else "Pivot: an index column is not fixed", key)]

    def required(self, i):
        return False  # a row may be there for other header values only

    def keys(self, keys, columns):
        return {frozenset(self.index)}


class UnPivot(Node):
    """A row for each row and each of value_vars: the id columns, the column's name and its value."""

    def __init__(self, dep: Node, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value"):
        super().__init__(dep)
        self.ids, self.vars, self.var_name, self.value_name = list(id_vars), list(value_vars), var_name, value_name

    def build(self, df):
        return df.unpivot([*[name(c) for c in self.ids], *carried(df)], [name(c) for c in self.vars], self.var_name, self.value_name).select(*[name(c) for c in [*self.ids, self.var_name, self.value_name]], *carried(df))

    def updated(self):
        return frozenset({self.var_name, self.value_name})

    def comes_from(self, column, columns):
        return (0, column, True) if column in self.ids else None

    def push(self, f, columns, out):
        # A row is asked for if any of the rows it becomes is.
        return [Push(simplify(any_of(_decided(f.substitute({self.var_name: Lit(v), self.value_name: Field(v)})) for v in self.vars)))]

    def keys(self, keys, columns):
        return {k | {self.var_name} for k in keys[0] if k <= set(self.ids)}


def _decided(p: Expr) -> Expr:
    """p with atoms of constants replaced by their truth."""
    from ..predicate import Or, nnf, truth

    def walk(q: Expr) -> Expr:
        if isinstance(q, (And, Or)):
            return type(q)(walk(q.left), walk(q.right))
        if not q.columns() and not isinstance(q, Lit):
            return TRUE if truth(q) is True else FALSE
        return q

    return simplify(walk(nnf(p)))


class SortValues(Node):
    """Rows in order; nulls last, whichever way a column runs."""

    def __init__(self, dep: Node, cols: Sequence[str], desc: Sequence[bool] | bool = False):
        super().__init__(dep)
        self.cols = list(cols)
        self.desc = [desc] * len(self.cols) if isinstance(desc, bool) else list(desc)

    def _order(self):
        return [name(c).desc_nulls_last() if d else name(c).asc_nulls_last() for c, d in zip(self.cols, self.desc, strict=True)]

    def comes_from(self, column, columns):
        return 0, column, not isinstance(self, TopN)

    def build(self, df):
        return df.orderBy(*self._order())

    def push(self, f, columns, out):
        return [Push(f)]


class TopN(SortValues):
    """The first n rows of the order; ties are broken by all columns, so reruns agree."""

    def __init__(self, dep: Node, n: int, cols: Sequence[str], desc: Sequence[bool] | bool = False):
        super().__init__(dep, cols, desc)
        self.n = n

    def build(self, df: DataFrame):
        rest = [c for c in data_columns(df) if c not in self.cols]
        return df.orderBy(*self._order(), *[name(c).asc_nulls_last() for c in rest]).limit(self.n)

    def push(self, f, columns, out):
        # Other rows decide who is among the first, so nothing may be pruned. A row that
        # is known to be among them is its own lineage; equal rows can't be told apart.
        if set(out) <= pinned(f):
            return [Push(f, Status.EXACT, "", TRUE)]
        return [Push(f, Status.SUPERSET, "TopN: the row is not fixed", TRUE)]


__all__ = ["Pivot", "SortValues", "TopN", "UnPivot"]
