"""Operators with a pipeline inside: scalars, correlated subqueries, functions of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..predicate import FALSE, TRUE, And, Case, Expr, Field, Lit, any_of, pinned, simplify, truth, weaken
from .aggregates import Agg, group_push
from .base import LINEAGE, Node, Push, References, Status, data_columns, gathered, members_by, name

_NONE = "array<struct<source:string,rid:string>>"


class ScalarComputation(Node):
    """One row with one column: an expression of one-row inputs, named by the dict."""

    def __init__(self, deps: Mapping[str, Node], expr: Expr, new_col: str = "value"):
        super().__init__(*deps.values())
        self.names, self.expr, self.new_col = list(deps), expr, new_col

    def _one(self, frames: Sequence[DataFrame], lineage: bool) -> DataFrame:
        out: DataFrame | None = None
        for i, (n, df) in enumerate(zip(self.names, frames, strict=True)):
            value = name(data_columns(df)[0]).alias(n)
            one = df.select(value, *([F.col(LINEAGE).alias(f"__l{i}")] if lineage else []))
            out = one if out is None else out.crossJoin(F.broadcast(one))  # inputs have one row
        extra = [F.concat(*[F.col(f"__l{i}") for i in range(len(frames))]).alias(LINEAGE)] if lineage else []
        return out.select(self.expr.to_column().alias(self.new_col), *extra)

    def build(self, *frames):
        return self._one(frames, False)

    def track(self, *frames):
        return self._one(frames, True)

    def push(self, f, columns, out):
        return [Push(TRUE) for _ in columns]

    def keys(self, keys, columns):
        return {frozenset()}


class SetItemWithDependency(Node):
    """A derived column of a row and of the one-row results of other operators, named by the dict."""

    def __init__(self, dep: Node, new_col: str, deps: Mapping[str, Node], expr: Expr):
        super().__init__(dep, *deps.values())
        self.new_col, self.names, self.expr = new_col, list(deps), expr

    def _with(self, df: DataFrame, frames: Sequence[DataFrame]) -> DataFrame:
        own = [c for c in df.columns if c != self.new_col]
        for i, (n, one) in enumerate(zip(self.names, frames, strict=True)):
            extra = [F.col(LINEAGE).alias(f"__l{i}")] if LINEAGE in one.columns else []
            df = df.crossJoin(F.broadcast(one.select(name(data_columns(one)[0]).alias(f"__s_{n}"), *extra)))  # one row
        value = self.expr.substitute({n: Field(f"__s_{n}") for n in self.names}).to_column().alias(self.new_col)
        data = [name(c) for c in own if c != LINEAGE]
        lineage = [F.concat(LINEAGE, *[F.col(f"__l{i}") for i in range(len(frames))]).alias(LINEAGE)] if LINEAGE in own else []
        return df.select(*data, value, *lineage)

    def build(self, df, *frames):
        return self._with(df, frames)

    def track(self, df, *frames):
        return self._with(df, frames)

    def updated(self):
        return frozenset({self.new_col})

    def comes_from(self, column, columns):
        return (0, column, True) if column != self.new_col and column in columns[0] else None

    def push(self, f, columns, out):
        others = [Push(TRUE) for _ in self.names]
        if self.new_col not in f.columns():
            return [Push(f), *others]
        own = set(out) - {self.new_col}
        rest = weaken(f, {self.new_col})
        exact = own <= pinned(f)  # then the scalar was the one there is
        return [Push(rest, Status.EXACT if exact else Status.SUPERSET, "" if exact else "SetItemWithDependency: depends on a scalar that is not known here"), *others]


def outer(column: str) -> Field:
    """In a subquery's condition, a column of the outer row."""
    return Field(f"outer.{column}")


class SubpipeInput(Node):
    """Marks where a nested pipeline gets its table; the same rows. The outer row is outer(column), a group is what GroupedMap hands on."""

    def __init__(self, dep: Node, input_type: str = "table"):
        super().__init__(dep)
        if input_type not in ("table", "row", "group"):
            raise KeyError(input_type)
        self.input_type = input_type

    def build(self, df):
        return df

    def comes_from(self, column, columns):
        return 0, column, True

    def push(self, f, columns, out):
        return [Push(f)]


@dataclass(frozen=True)
class Subquery:
    """A correlated scalar subquery: agg over the rows of table whose columns equal the outer row's, and for which condition holds.

    on: pairs (outer column, table column). condition: on table columns and outer(...) ones.
    """

    table: Node
    on: Sequence[tuple[str, str]]
    agg: Agg
    condition: Expr | None = None

    def outer_columns(self) -> list[str]:
        extra = [c.removeprefix("outer.") for c in sorted(self.condition.columns()) if c.startswith("outer.")] if self.condition is not None else []
        return list(dict.fromkeys([*[a for a, _ in self.on], *extra]))


@dataclass(frozen=True)
class PipelinePath:
    """One branch: the value of a subquery, or of an expression of the outer row, under a condition on the outer row."""

    value: Subquery | Expr
    condition: Expr = TRUE


@dataclass(frozen=True)
class SubPipeline:
    """If/else over branches; the first whose condition holds gives the value, null if none does."""

    paths: Sequence[PipelinePath]


class CrosstableUDF(Node):
    """For each row, the value of a nested pipeline over other tables: a correlated subquery.

    It never runs row by row. Without a further condition the table is aggregated by its
    correlation keys and joined; with one, the distinct outer values are joined with
    the table first. A count over no rows is 0, other aggregates are null.
    """

    def __init__(self, dep: Node, new_col: str, subpipeline: SubPipeline | Subquery):
        self.paths = list((subpipeline if isinstance(subpipeline, SubPipeline) else SubPipeline([PipelinePath(subpipeline)])).paths)
        self.new_col = new_col
        self.queries = [p.value for p in self.paths if isinstance(p.value, Subquery)]
        super().__init__(dep, *[q.table for q in self.queries])

    def _values(self, q: Subquery, left: DataFrame, table: DataFrame, i: int, lineage: bool, refs: References | None) -> DataFrame:
        """(outer columns as __o<i>_<k>, __v<i>, __l<i>) for the outer values that have rows."""
        if refs:
            out = self._values(q, left, table, i, False, None)
            return out.withColumn(f"__l{i}", refs.to(out, [c for c in out.columns if c != f"__v{i}"], self._members(q, table)))
        extra = [F.flatten(F.collect_list(LINEAGE)).alias(f"__l{i}")] if lineage else []
        value = q.agg.column().alias(f"__v{i}")
        if q.condition is None:
            return table.groupBy(*[name(b).alias(f"__o{i}_{k}") for k, (_, b) in enumerate(q.on)]).agg(value, *extra)
        outs = q.outer_columns()
        asked = left.select(*[name(c).alias(f"outer.{c}") for c in outs]).distinct()
        test = q.condition.to_column()
        for a, b in q.on:
            test = test & (name(f"outer.{a}") == name(b))
        return asked.join(table, test).groupBy(*[name(f"outer.{c}").alias(f"__o{i}_{k}") for k, c in enumerate(outs)]).agg(value, *extra)

    def _members(self, q: Subquery, table: DataFrame) -> Callable[[DataFrame], DataFrame]:
        if q.condition is None:
            return members_by(table, [b for _, b in q.on])

        def members(keys: DataFrame) -> DataFrame:
            test = q.condition.to_column()
            for a, b in q.on:
                test = test & (name(f"outer.{a}") == name(b))
            return keys.select(*[F.col(f"__k{k}").alias(f"outer.{c}") for k, c in enumerate(q.outer_columns())]).join(table, test)

        return members

    def _build(self, left: DataFrame, tables: Sequence[DataFrame], lineage: bool, refs: References | None = None) -> DataFrame:
        own = [c for c in data_columns(left) if c != self.new_col]
        out, branches, i = left, [], 0
        for p in self.paths:
            if isinstance(p.value, Subquery):
                q = p.value
                values = self._values(q, left, tables[i], i, lineage, refs)
                test, outs = F.lit(True), q.outer_columns() if q.condition is not None else [a for a, _ in q.on]
                for k, c in enumerate(outs):
                    test = test & (name(c) == F.col(f"__o{i}_{k}") if q.condition is None else name(c).eqNullSafe(F.col(f"__o{i}_{k}")))
                out = out.join(values, test, "left")
                v: Expr = Field(f"__v{i}")
                if q.agg.fn in ("count", "count_distinct", "approx_count_distinct"):
                    out = out.withColumn(f"__v{i}", F.coalesce(f"__v{i}", F.lit(0)))
                branches.append((p.condition, v, F.col(f"__l{i}") if lineage else None))
                i += 1
            else:
                branches.append((p.condition, p.value, F.array().cast(_NONE) if lineage else None))
        value = Case(tuple((c, v) for c, v, _ in branches)).to_column() if len(branches) > 1 or not _always(branches[0][0]) else branches[0][1].to_column()
        data = [*[name(c) for c in own], value.alias(self.new_col)]
        if not lineage:
            return out.select(*data)
        theirs = F.lit(None).cast(_NONE)
        for c, _, l in reversed(branches):
            theirs = F.when(c.to_column(), l).otherwise(theirs)
        return out.select(*data, F.concat(LINEAGE, F.coalesce(theirs, F.array().cast(_NONE))).alias(LINEAGE))

    def build(self, left, *tables):
        return self._build(left, tables, False)

    def track(self, left, *tables):
        return self._build(left, tables, True)

    def refer(self, refs, left, *tables):
        return self._build(left, tables, True, refs)

    def required(self, i):
        return i == 0

    def comes_from(self, column, columns):
        return (0, column, True) if column != self.new_col and column in columns[0] else None

    def updated(self):
        return frozenset({self.new_col})

    def push(self, f, columns, out):
        fixed, rest = pinned(f), weaken(f, {self.new_col})
        need = {c for q in self.queries for c in q.outer_columns()} | {c for p in self.paths for c in p.condition.columns()}
        exact = need <= fixed
        # The value follows from the correlated columns; a row that agrees on all of them and on f's other atoms is f's.
        left_exact = exact or self.new_col not in f.columns()
        status = Status.EXACT if exact else Status.SUPERSET
        reason = "" if exact else "CrosstableUDF: a correlated column is not fixed"
        pushes = [Push(rest, Status.EXACT if left_exact else Status.SUPERSET, "" if left_exact else reason)]
        from .joins import _equalities

        values = {q.left.name: q.right for q in _equalities(f)}
        from ..predicate import implied_pins

        taken: list[Expr] = []
        for p in self.paths:
            mine = _truth(p.condition.substitute(values)) if not _always(p.condition) else TRUE
            if not isinstance(p.value, Subquery):
                continue
            q = p.value
            pairs = [(a, f"\x00{b}") for a, b in q.on]
            key = weaken(implied_pins(f, pairs), {c for c in f.columns()}).substitute({f"\x00{b}": Field(b) for _, b in q.on})
            match = key
            if q.condition is not None:
                bound = q.condition.substitute({f"outer.{c}": v for c, v in values.items()})
                match = simplify(And(key, weaken(bound, {c for c in bound.columns() if c.startswith("outer.")})))
            if mine is FALSE or any(t is TRUE for t in taken):
                match = FALSE
            taken.append(mine)
            pushes.append(Push(match, status, reason, key))
        return pushes


def _always(p: Expr) -> bool:
    return isinstance(p, Lit) and p.value is True


def _truth(p: Expr) -> Expr:
    if p.columns():
        return p
    return TRUE if truth(p) is True else FALSE


def _group_by_group(fn: Callable, keys: Sequence[str], columns: Sequence[str], made: Sequence[str], whole: Mapping[str, bool]) -> Callable[[Iterator], Iterator]:
    """A function of batches in which the rows of a group stand together, __first marking each group's first: fn's rows of every group, keys in front.

    whole: columns whose nulls __null0, __null1, ... mark, and whether they become floats where there are any.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        names = list(made)

        def with_nulls(values: pd.Series, null: np.ndarray, real: bool) -> pd.Series:
            return values.astype("float64" if real else object).mask(null, np.nan if real else None)

        def results(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
            """Of a frame of whole groups that begin at starts."""
            data, nulls = pdf[list(columns)], {c: n for i, c in enumerate(whole) if (n := pdf[f"__null{i}"].to_numpy(bool)).any()}
            ready: list[pd.DataFrame] = []
            of: list[int] = []
            types: list = []

            def flush() -> pd.DataFrame:
                out = pd.concat(ready, ignore_index=True)
                at = np.repeat(of, [len(r) for r in ready])
                for i, k in enumerate(keys):
                    v = data[k].iloc[at].reset_index(drop=True)
                    out.insert(i, k, v.astype(object).mask(nulls[k][at], None) if k in nulls else v)
                ready.clear(), of.clear()
                return out

            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
                part = data.iloc[a:b].reset_index(drop=True)
                for c, n in nulls.items():
                    if n[a:b].any():
                        part[c] = with_nulls(part[c], n[a:b], whole[c])
                out = fn(part)
                if len(out.columns) != len(made):
                    raise ValueError(f"the function of a group gives {list(out.columns)}, not {names}")
                if (given := out.columns.tolist()) != names:
                    out = out[names] if all(isinstance(c, str) for c in given) else out.set_axis(names, axis=1)
                if not len(out):
                    continue
                if (own := out.dtypes.tolist()) != types and ready:  # joined, one would take the other's type
                    yield flush()
                types = own
                ready.append(out)
                of.append(a)
            if ready:
                yield flush()

        held: list[pd.DataFrame] = []  # the group that may go on in the next batch
        for pdf in batches:
            starts = np.flatnonzero(pdf["__first"].to_numpy(bool))
            if not len(starts):
                held.append(pdf)
                continue
            if held:
                yield from results(pd.concat([*held, pdf.iloc[: starts[0]]], ignore_index=True), np.zeros(1, int))
            if len(starts) > 1:
                yield from results(pdf.iloc[starts[0] : starts[-1]].reset_index(drop=True), starts[:-1] - starts[0])
            held = [pdf.iloc[starts[-1] :]]
        if held:
            yield from results(pd.concat(held, ignore_index=True), np.zeros(1, int))

    return run


class GroupedMap(Node):
    """A function of each group: aggregates, or a table from a pandas function.

    aggs: built-in aggregates, which spread any group over tasks; several columns, or
    one named `0` by default. fn: pandas frame to pandas frame of the given schema; its
    rows get the group's keys in front. A group given to fn is held by one task, which
    is what the function asks for; use aggs wherever they can say it. Groups travel to
    and from Python many in a batch, so that small ones cost little more than fn itself.
    """

    def __init__(self, dep: Node, keys: Sequence[str], aggs: Sequence[Agg] = (), fn: Callable | None = None, schema: str | None = None):
        super().__init__(dep)
        if bool(aggs) == (fn is not None):
            raise ValueError("give either aggregates or a function")
        self.by, self.fn, self.schema = list(keys), fn, schema
        self.aggs = [Agg(a.fn, a.of, "0" if len(aggs) == 1 and a.alias in ("", None) else a.alias, a.when) for a in aggs]

    def _mapped(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.types import BooleanType, IntegralType, StructType

        columns, made = data_columns(df), StructType.fromDDL(self.schema)
        schema = StructType([df.schema[k] for k in self.by] + made.fields)
        # Pandas makes floats of integers with nulls. A batch has many groups, so nulls are marked and put back group by group.
        whole = [c for c in columns if df.schema[c].nullable and isinstance(df.schema[c].dataType, (IntegralType, BooleanType))]
        real = {c: isinstance(df.schema[c].dataType, IntegralType) for c in whole}
        filled = [F.coalesce(name(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in real else name(c) for c in columns]
        if self.by:  # a given number of tasks: by their bytes alone, few would do the work of all groups
            df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[name(k) for k in self.by])
        first = F.row_number().over(Window.partitionBy(*[name(k) for k in self.by]).orderBy(F.lit(1))) == 1
        rows = df.select(*filled, *[name(c).isNull().alias(f"__null{i}") for i, c in enumerate(whole)], first.alias("__first"))
        return rows.mapInPandas(_group_by_group(self.fn, self.by, columns, made.names, real), schema)

    def build(self, df):
        return self._mapped(df) if self.fn else df.groupBy(*[name(c) for c in self.by]).agg(*[a.column() for a in self.aggs])

    def track(self, df):
        out = self.build(df.drop(LINEAGE))
        every = df.groupBy(*[name(c).alias(f"__k{i}") for i, c in enumerate(self.by)]).agg(gathered())
        test = F.lit(True)
        for i, c in enumerate(self.by):
            test = test & name(c).eqNullSafe(F.col(f"__k{i}"))
        return out.join(every, test).select(*[name(c) for c in data_columns(out)], LINEAGE)

    def refer(self, refs, df):
        out = self.build(df.drop(LINEAGE))
        return out.withColumn(LINEAGE, refs.to(out, self.by, members_by(df, self.by)))

    def updated(self):
        return frozenset(a.alias for a in self.aggs)

    def push(self, f, columns, out):
        return [group_push(self, f, self.by, out)]

    def keys(self, keys, columns):
        return {frozenset(self.by)} if self.aggs else set()


class CogroupedMap(Node):
    """A pandas function of the two groups with one key value, one of them empty where a side lacks it; its rows get the keys in front."""

    def __init__(self, left: Node, right: Node, keys: Sequence[str], fn: Callable, schema: str):
        super().__init__(left, right)
        self.by, self.fn, self.schema = list(keys), fn, schema

    def build(self, left, right):
        from pyspark.sql.types import StructType

        keys, fn = self.by, self.fn
        schema = StructType([left.schema[k] for k in keys] + StructType.fromDDL(self.schema).fields)

        def run(group, a, b):
            out = fn(a, b)
            for i, (k, v) in enumerate(zip(keys, group, strict=True)):
                out.insert(i, k, v)
            return out

        l, r = (df.select(*[name(c) for c in data_columns(df)]).groupBy(*[name(k) for k in keys]) for df in (left, right))
        return l.cogroup(r).applyInPandas(run, schema)

    def track(self, left, right):
        out = self.build(left.drop(LINEAGE), right.drop(LINEAGE))
        both = left.select(*[name(c).alias(f"__k{i}") for i, c in enumerate(self.by)], LINEAGE).unionByName(right.select(*[name(c).alias(f"__k{i}") for i, c in enumerate(self.by)], LINEAGE))
        every = both.groupBy(*[F.col(f"__k{i}") for i in range(len(self.by))]).agg(gathered())
        test = F.lit(True)
        for i, c in enumerate(self.by):
            test = test & name(c).eqNullSafe(F.col(f"__k{i}"))
        return out.join(every, test).select(*[name(c) for c in data_columns(out)], LINEAGE)

    def refer(self, refs, left, right):
        out = self.build(left.drop(LINEAGE), right.drop(LINEAGE))
        of = [members_by(df, self.by) for df in (left, right)]
        return out.withColumn(LINEAGE, refs.to(out, self.by, lambda keys: of[0](keys).select(LINEAGE).unionByName(of[1](keys).select(LINEAGE))))

    def push(self, f, columns, out):
        return [group_push(self, f, self.by, out)] * 2

    def required(self, i):
        return False

    def keys(self, keys, columns):
        return set()


__all__ = ["CogroupedMap", "CrosstableUDF", "GroupedMap", "PipelinePath", "ScalarComputation", "SetItemWithDependency", "SubPipeline", "Subquery", "SubpipeInput", "any_of", "outer"]
