"""Operators over groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..predicate import TRUE, Case, Expr, Field, Lit, lit, pinned, weaken
from .base import LINEAGE, Node, Push, Status, carried, data_columns, gathered, members_by, name

_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.mean, "avg": F.mean, "max": F.max, "min": F.min, "count": F.count, "count_distinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct,
    "unique": lambda c: F.sort_array(F.collect_set(c)), "product": F.product, "first": F.first, "stddev": F.stddev, "any": F.bool_or, "all": F.bool_and,
}


@dataclass(frozen=True)
class Agg:
    """One aggregate: a function's name, what it is of, and the output column."""

    fn: str
    of: Expr
    alias: str
    when: Expr | None = None

    def column(self) -> Column:
        of = self.of if self.when is None else Case(((self.when, self.of),))
        return _FUNCTIONS[self.fn](of.to_column()).alias(self.alias)


def agg(fn: str, of: Expr | str | Any = 1, alias: str | None = None, when: Expr | None = None) -> Agg:
    """agg("sum", "x"), agg("count"), agg("sum", col("a") * col("b"), "total", when=col("c") > 0)."""
    if fn not in _FUNCTIONS:
        raise KeyError(f"no aggregate {fn}; there are {', '.join(sorted(_FUNCTIONS))}")
    return Agg(fn, Field(of) if isinstance(of, str) else lit(of), alias or (of if isinstance(of, str) else fn), when)


class GroupBy(Node):
    """Aggregates by keys; several may be of one column. A null key is a group, as in SQL. HAVING is a Filter after it."""

    def __init__(self, dep: Node, groupby_cols: Sequence[str], aggs: Sequence[Agg]):
        super().__init__(dep)
        self.by, self.aggs = list(groupby_cols), list(aggs)

    def build(self, df):
        return df.groupBy(*[name(c) for c in self.by]).agg(*[a.column() for a in self.aggs])

    def track(self, df):
        return df.groupBy(*[name(c) for c in self.by]).agg(*[a.column() for a in self.aggs], gathered())

    def refer(self, refs, df):
        out = self.build(df)
        return out.withColumn(LINEAGE, refs.to(out, self.by, members_by(df, self.by)))

    def updated(self):
        return frozenset(a.alias for a in self.aggs)

    def comes_from(self, column, columns):
        return (0, column, True) if column in self.by else None

    def decided_by(self, i, f, columns):
        # Then all rows asked for are in one group, and that is the one f is true of.
        return frozenset(self.by)

    def push(self, f, columns, out):
        return [group_push(self, f, self.by, out)]

    def keys(self, keys, columns):
        return {frozenset(self.by)}


def group_push(node: Node, f: Expr, by: Sequence[str], out: Sequence[str]) -> Push:
    """Atoms on the keys go down; exact if the keys are fixed, or if f asks about nothing else."""
    key = weaken(f, set(out) - set(by))
    if set(by) <= pinned(f) or f.columns() <= set(by):
        return Push(key)
    return Push(key, Status.SUPERSET, f"{node!r}: a group key is not fixed")


class GroupingSets(Node):
    """Aggregates by several sets of keys at once; a key outside a row's set is null. kind: cube, rollup, or a list of sets."""

    def __init__(self, dep: Node, groupby_cols: Sequence[str], aggs: Sequence[Agg], kind: str | Sequence[Sequence[str]] = "cube"):
        super().__init__(dep)
        self.by, self.aggs, self.kind = list(groupby_cols), list(aggs), kind

    def _grouped(self, df: DataFrame):
        cols = [name(c) for c in self.by]
        if isinstance(self.kind, str):
            return getattr(df, self.kind)(*cols)
        return df.groupingSets([[name(c) for c in s] for s in self.kind], *cols)

    def build(self, df):
        return self._grouped(df).agg(*[a.column() for a in self.aggs])

    def track(self, df):
        return self._grouped(df).agg(*[a.column() for a in self.aggs], gathered())

    def push(self, f, columns, out):
        # A null key may mean "all", so nothing can be said of one row's keys.
        return [Push(TRUE, Status.SUPERSET, "GroupingSets: a null key may stand for all values")]


class AllAggregate(Node):
    """One row for the whole input: aggregates, or a fold given by (start, step, merge).

    step(state, row) takes a row as a dict, merge joins two states; both must not depend
    on the order of rows. Each task folds its own rows, and only the states, one for
    each task that has rows, meet in one. Every task begins with `start`, so it has to
    change nothing: merge(start, s) is tested to be s. Then the result is the same
    however the rows are dealt.
    """

    def __init__(self, dep: Node, aggs: Sequence[Agg] = (), fold: tuple[Any, Callable, Callable] | None = None, alias: str = "value", returns: str = "double"):
        super().__init__(dep)
        if bool(aggs) == bool(fold):
            raise ValueError("give either aggregates or a fold")
        self.aggs, self.fold, self.alias, self.returns = list(aggs), fold, alias, returns

    def _folded(self, df: DataFrame) -> DataFrame:
        start, step, merge = self.fold
        column, schema = self.alias, f"`{self.alias}` {self.returns}"

        def rows(parts: Iterator) -> Iterator:
            import pandas as pd

            state, any_row = start, False
            for pdf in parts:
                any_row = any_row or len(pdf) > 0
                for row in pdf.to_dict("records"):
                    state = step(state, row)
            if any_row:
                yield pd.DataFrame({column: [state]})

        def states(parts: Iterator) -> Iterator:
            import pandas as pd

            state, first = start, True
            for pdf in parts:
                for s in pdf[column]:
                    if merge(start, s) != s and s == s:
                        raise ValueError(f"the start of a fold must change nothing, but merge({start!r}, {s!r}) is {merge(start, s)!r}")
                    state, first = s if first else merge(state, s), False
            yield pd.DataFrame({column: [state]})

        # An exchange, so that the fold below it keeps its tasks; one state of each comes through.
        return df.select(*[name(c) for c in data_columns(df)]).mapInPandas(rows, schema).repartition(1).mapInPandas(states, schema)

    def build(self, df):
        return self._folded(df) if self.fold else df.agg(*[a.column() for a in self.aggs])

    def track(self, df):
        if self.fold:
            return self._folded(df).crossJoin(df.agg(gathered()))
        return df.agg(*[a.column() for a in self.aggs], gathered())

    def refer(self, refs, df):
        out = self.build(df)
        return out.withColumn(LINEAGE, refs.to(out, [], members_by(df, [])))

    def push(self, f, columns, out):
        return [Push(TRUE)]

    def keys(self, keys, columns):
        return {frozenset()}


def has_map(kind: str) -> bool:
    return "map<" in kind


def sortable(df: DataFrame, column: str) -> Column:
    """What a column is ordered by: itself, or, where it holds maps, which have no order, its text."""
    return F.when(name(column).isNotNull(), F.to_json(F.struct(name(column)))) if has_map(dict(df.dtypes)[column]) else name(column)


class DropDuplicate(Node):
    """One row for each value of cols: the first by `order`, then by all columns, so reruns agree.

    lineage: `kept` is the row that stays (rows equal to it in all columns can't be told
    apart and count with it), `all` every row of the group.
    """

    def __init__(self, dep: Node, cols: Sequence[str], order: Sequence[str] = (), lineage: str = "kept"):
        super().__init__(dep)
        self.cols, self.order, self.lineage = list(cols), list(order), lineage

    def _window(self, df: DataFrame):
        own = data_columns(df)
        order = [*self.order, *[c for c in own if c not in self.order and c not in self.cols]]
        return Window.partitionBy(*[name(c) for c in self.cols]).orderBy(*([sortable(df, c).asc_nulls_last() for c in order] or [F.lit(1)]))

    def build(self, df):
        own = data_columns(df)
        order = [*self.order, *[c for c in own if c not in self.order and c not in self.cols]]
        if any(has_map(t) for c, t in df.dtypes if c in order) or LINEAGE in df.columns:  # maps have no least one
            return df.withColumn("__n", F.row_number().over(self._window(df))).filter("__n = 1").drop("__n")
        # The least row of each key, combined before the shuffle; nulls last, as a flag in front of each column.
        parts = [x for i, c in enumerate(order) for x in (name(c).isNull().alias(f"n{i}"), name(c).alias(f"c{i}"))]
        least = df.groupBy(*[name(c) for c in self.cols]).agg(F.min(F.struct(*parts) if parts else F.lit(1)).alias("__least"))
        place = {c: i for i, c in enumerate(order)}
        return least.select(*[name(c) if c in self.cols and c not in place else F.col("__least").getField(f"c{place[c]}").alias(c) for c in own])

    def track(self, df):
        own = data_columns(df)
        if self.lineage == "kept":
            first = df.withColumn("__n", F.rank().over(self._window(df))).filter("__n = 1")
            return first.groupBy(*[name(c) for c in own]).agg(gathered())
        kept = self.build(df.drop(LINEAGE))
        every = df.groupBy(*[name(c).alias(f"__k{i}") for i, c in enumerate(self.cols)]).agg(gathered())
        test = F.lit(True)
        for i, c in enumerate(self.cols):
            test = test & name(c).eqNullSafe(F.col(f"__k{i}"))
        return kept.join(every, test).select(*[name(c) for c in own], LINEAGE)

    def refer(self, refs, df):
        if self.lineage == "kept":
            return self.track(df)
        out = self.build(df.drop(LINEAGE))
        return out.withColumn(LINEAGE, refs.to(out, self.cols, members_by(df, self.cols)))

    def push(self, f, columns, out):
        key = weaken(f, set(out) - set(self.cols))
        exact = set(self.cols) <= pinned(f) or f.columns() <= set(self.cols)
        if self.lineage == "all":
            return [Push(key, Status.EXACT if exact else Status.SUPERSET, "" if exact else "DropDuplicate: a key is not fixed")]
        # Of a row that is known to stay, all atoms may be asked of the input.
        whole = set(out) <= pinned(f)
        return [Push(f if whole else key, Status.EXACT if whole else Status.SUPERSET, "" if whole else "DropDuplicate: the kept row is not fixed", key)]

    def keys(self, keys, columns):
        return keys[0] | {frozenset(self.cols)}


class CumAggr(Node):
    """A running aggregate along an order: new_col is fn of column over the rows so far, ties by all columns.

    Without partition_by the order is global. It is cut into ranges of the whole order,
    ties included, so that only rows equal in all columns stay together; each range is
    summed up on its own and gets the total of those before it, so no task holds the whole
    input. The ranges are written once, as their bounds are sampled.
    """

    def __init__(self, dep: Node, column: str, fn: str, order: Sequence[str], new_col: str | None = None, partition_by: Sequence[str] = (), ranges: int = 64):
        super().__init__(dep)
        if fn not in ("sum", "min", "max", "prod", "count"):
            raise KeyError(fn)
        self.column, self.fn, self.order, self.new_col, self.by, self.ranges = column, fn, list(order), new_col or f"cum_{fn}", list(partition_by), ranges

    def updated(self):
        return frozenset({self.new_col})

    def _fn(self, c: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product, "count": F.count}[self.fn](c)

    def _plus(self, a: Column, b: Column) -> Column:
        """Two totals as one; null is nothing."""
        both = {"sum": a + b, "prod": a * b, "count": a + b, "min": F.least(a, b), "max": F.greatest(a, b)}[self.fn]
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)

    def build(self, df):
        own = [c for c in data_columns(df) if c != self.new_col]
        order = [sortable(df, c).asc_nulls_last() for c in [*self.order, *[c for c in own if c not in self.order]]]
        rows = (Window.unboundedPreceding, Window.currentRow)
        if self.by:
            return df.withColumn(self.new_col, self._fn(name(self.column)).over(Window.partitionBy(*[name(c) for c in self.by]).orderBy(*order).rowsBetween(*rows)))
        from ..sources.scratch import stored

        d = stored(df.repartitionByRange(self.ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
        totals = d.groupBy("__range").agg(self._fn(name(self.column)).alias("__total"))
        before = totals.select(F.col("__range").alias("__of"), self._fn(F.col("__total")).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before")) if self.fn != "count" else totals.select(
            F.col("__range").alias("__of"), F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
        inner = self._fn(name(self.column)).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(*rows))
        # at most `ranges` rows, so they are broadcast
        out = d.withColumn("__own", inner).join(F.broadcast(before), F.col("__range") == F.col("__of"))
        return out.withColumn(self.new_col, self._plus(F.col("__before"), F.col("__own"))).select(*[name(c) for c in own], name(self.new_col), *carried(d))

    def track(self, df):
        own = [c for c in data_columns(df) if c != self.new_col]
        out = self.build(df.withColumn("__mine", F.col(LINEAGE)).drop(LINEAGE))
        order = [name(c).asc_nulls_last() for c in [*self.order, *[c for c in own if c not in self.order]]]
        upto = Window.partitionBy(*[name(c) for c in self.by]).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return out.withColumn(LINEAGE, F.flatten(F.collect_list("__mine").over(upto))).drop("__mine")

    def refer(self, refs, df):
        mine = df.withColumn("__mine", F.col(LINEAGE))
        own = [c for c in data_columns(mine) if c != self.new_col]
        places = [sortable(mine, c).alias(f"__p{i}") for i, c in enumerate([*self.order, *[c for c in own if c not in self.order]])]

        def place(columns: Sequence[str]) -> Column:
            """Ordered as the running order is: nulls last."""
            return F.struct(*[x for i, c in enumerate(columns) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))])

        def members(keys: DataFrame) -> DataFrame:
            # Of the rows asked for in a partition, the last has all others' lineage.
            n = len(self.by)
            last = keys.groupBy(*[f"__k{i}" for i in range(n)]).agg(F.max(place([f"__k{n + i}" for i in range(len(places))])).alias("__last"))
            rows = mine.select(*[name(c).alias(f"__b{i}") for i, c in enumerate(self.by)], *places, LINEAGE)
            test = place([f"__p{i}" for i in range(len(places))]) <= F.col("__last")
            for i in range(n):
                test = test & F.col(f"__b{i}").eqNullSafe(F.col(f"__k{i}"))
            return rows.join(last if n else F.broadcast(last), test)

        out = self.build(mine.drop(LINEAGE))
        placed = out.select(*[name(c) for c in data_columns(out)], *places)
        reference = refs.to(placed, [*self.by, *[f"__p{i}" for i in range(len(places))]], members)
        return placed.withColumn(LINEAGE, reference).select(*[name(c) for c in data_columns(out) if c != "__mine"], LINEAGE)

    def push(self, f, columns, out):
        key = weaken(f, set(out) - set(self.by))
        return [Push(key, Status.SUPERSET, "CumAggr: the rows before a row are its lineage", key)]


__all__ = ["Agg", "AllAggregate", "CumAggr", "DropDuplicate", "GroupBy", "GroupingSets", "Lit", "agg", "group_push"]
