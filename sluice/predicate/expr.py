"""The expression tree: what a pipeline's conditions and derived columns are written in.

Every node compiles to a Spark column, evaluates on a plain Python row (for bounded
tests), renders as SQL, names the columns it uses and lets them be substituted.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True, eq=False)
class Expr:
    """Base of all expressions. Python's operators build larger ones; == and != are SQL's."""

    def to_column(self) -> Column:
        raise NotImplementedError

    def eval_row(self, row: Mapping[str, Any]) -> Any:
        """The value on a row of Python values, None being null, with SQL's three-valued logic."""
        raise NotImplementedError

    def to_sql(self) -> str:
        raise NotImplementedError

    def children(self) -> tuple[Expr, ...]:
        return tuple(x for f in fields(self) for x in _parts(getattr(self, f.name)))

    def rebuild(self, change: Callable[[Expr], Expr]) -> Expr:
        """This node over changed children."""
        return type(self)(**{f.name: _changed(getattr(self, f.name), change) for f in fields(self)})

    def columns(self) -> frozenset[str]:
        return frozenset().union(*(c.columns() for c in self.children()))

    def substitute(self, by: Mapping[str, Expr]) -> Expr:
        """With columns replaced by expressions, all at once."""
        return self.rebuild(lambda c: c.substitute(by))

    def deterministic(self) -> bool:
        return all(c.deterministic() for c in self.children())

    def same(self, other: Expr) -> bool:
        return repr(self) == repr(other)

    def __eq__(self, other):  # type: ignore[override]
        return Cmp("==", self, lit(other))

    def __ne__(self, other):  # type: ignore[override]
        return Cmp("!=", self, lit(other))

    __hash__ = object.__hash__
    __lt__ = lambda self, o: Cmp("<", self, lit(o))
    __le__ = lambda self, o: Cmp("<=", self, lit(o))
    __gt__ = lambda self, o: Cmp(">", self, lit(o))
    __ge__ = lambda self, o: Cmp(">=", self, lit(o))
    __add__ = lambda self, o: Arith("+", self, lit(o))
    __sub__ = lambda self, o: Arith("-", self, lit(o))
    __mul__ = lambda self, o: Arith("*", self, lit(o))
    __truediv__ = lambda self, o: Arith("/", self, lit(o))
    __radd__ = lambda self, o: Arith("+", lit(o), self)
    __rsub__ = lambda self, o: Arith("-", lit(o), self)
    __rmul__ = lambda self, o: Arith("*", lit(o), self)
    __and__ = lambda self, o: And(self, lit(o))
    __or__ = lambda self, o: Or(self, lit(o))
    __invert__ = lambda self: Not(self)

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")

    def eq_null_safe(self, other: Any) -> Expr:
        return Cmp("<=>", self, lit(other))

    def is_null(self) -> Expr:
        return IsNull(self)

    def is_not_null(self) -> Expr:
        return Not(IsNull(self))

    def isin(self, *values: Any) -> Expr:
        return InSet(self, tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values)

    def contains(self, needle: Any) -> Expr:
        return Contains(self, lit(needle))

    def like(self, pattern: str) -> Expr:
        return Like(self, pattern)

    def between(self, low: Any, high: Any) -> Expr:
        return Between(self, lit(low), lit(high))

    def cast(self, to: str) -> Expr:
        return Cast(self, to)


def _parts(v: Any) -> Iterable[Expr]:
    if isinstance(v, Expr):
        yield v
    elif isinstance(v, tuple):
        for x in v:
            yield from _parts(x)


def _changed(v: Any, change: Callable[[Expr], Expr]) -> Any:
    if isinstance(v, Expr):
        return change(v)
    if isinstance(v, tuple):
        return tuple(_changed(x, change) for x in v)
    return v


def lit(v: Any) -> Expr:
    return v if isinstance(v, Expr) else Lit(v)


def col(name: str) -> Field:
    return Field(name)


def _plain(v: Any) -> Any:
    """Dates and times comparable with each other."""
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    return v


@dataclass(frozen=True, eq=False)
class Field(Expr):
    name: str

    def to_column(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")

    def eval_row(self, row):
        return row[self.name]

    def to_sql(self) -> str:
        return '"' + self.name.replace('"', '""') + '"'

    def columns(self):
        return frozenset({self.name})

    def substitute(self, by):
        return by.get(self.name, self)


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: Any

    def to_column(self) -> Column:
        if isinstance(self.value, dt.datetime):
            # literals are times without a zone, like the columns they are compared with
            return F.lit(str(self.value)).cast("timestamp_ntz")
        return F.lit(self.value)

    def eval_row(self, row):
        return self.value

    def to_sql(self) -> str:
        v = self.value
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, dt.datetime):
            return f"TIMESTAMP '{v}'"
        if isinstance(v, dt.date):
            return f"DATE '{v}'"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _least(*values):
    """Of those that aren't null, the smallest; NaN is larger than any number."""
    some = [v for v in values if v is not None]
    return min(some, key=_ordered) if some else None


def _greatest(*values):
    some = [v for v in values if v is not None]
    return max(some, key=_ordered) if some else None


def _ordered(v):
    return (v != v, 0 if v != v else v)


def _compared(op: str, a, b) -> bool:
    """Spark's order of values: NaN equals itself and is larger than any number."""
    if a != a or b != b:
        return _COMPARE[op](int(a != a), int(b != b))
    return _COMPARE[op](a, b)


_COMPARE: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True, eq=False)
class Cmp(Expr):
    """Comparison; <=> is equality under which nulls are equal."""

    op: str
    left: Expr
    right: Expr

    def to_column(self) -> Column:
        a, b = self.left.to_column(), self.right.to_column()
        return a.eqNullSafe(b) if self.op == "<=>" else _COMPARE[self.op](a, b)

    def eval_row(self, row):
        a, b = _plain(self.left.eval_row(row)), _plain(self.right.eval_row(row))
        if self.op == "<=>":
            return _compared("==", a, b) if a is not None and b is not None else a is b
        return None if a is None or b is None else _compared(self.op, a, b)

    def to_sql(self) -> str:
        op = {"==": "=", "!=": "<>", "<=>": "IS NOT DISTINCT FROM"}.get(self.op, self.op)
        return f"({self.left.to_sql()} {op} {self.right.to_sql()})"


_ARITH: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}


@dataclass(frozen=True, eq=False)
class Arith(Expr):
    """+ - * and /, whose result is null for a divisor of 0; min and max of two values ignore nulls."""

    op: str
    left: Expr
    right: Expr

    def to_column(self) -> Column:
        a, b = self.left.to_column(), self.right.to_column()
        if self.op == "/":
            return F.try_divide(a, b)
        return {"min": F.least, "max": F.greatest}[self.op](a, b) if self.op in ("min", "max") else _ARITH[self.op](a, b)

    def eval_row(self, row):
        a, b = self.left.eval_row(row), self.right.eval_row(row)
        if self.op in ("min", "max"):
            return {"min": _least, "max": _greatest}[self.op](a, b)
        return None if a is None or b is None or (self.op == "/" and b == 0) else _ARITH[self.op](a, b)

    def to_sql(self) -> str:
        a, b = self.left.to_sql(), self.right.to_sql()
        if self.op in ("min", "max"):
            return f"{ {'min': 'LEAST', 'max': 'GREATEST'}[self.op]}({a}, {b})"
        return f"({a} / NULLIF({b}, 0))" if self.op == "/" else f"({a} {self.op} {b})"


@dataclass(frozen=True, eq=False)
class And(Expr):
    left: Expr
    right: Expr

    def to_column(self) -> Column:
        return self.left.to_column() & self.right.to_column()

    def eval_row(self, row):
        a, b = self.left.eval_row(row), self.right.eval_row(row)
        return False if a is False or b is False else None if a is None or b is None else True

    def to_sql(self) -> str:
        return f"({self.left.to_sql()} AND {self.right.to_sql()})"


@dataclass(frozen=True, eq=False)
class Or(Expr):
    left: Expr
    right: Expr

    def to_column(self) -> Column:
        return self.left.to_column() | self.right.to_column()

    def eval_row(self, row):
        a, b = self.left.eval_row(row), self.right.eval_row(row)
        return True if a is True or b is True else None if a is None or b is None else False

    def to_sql(self) -> str:
        return f"({self.left.to_sql()} OR {self.right.to_sql()})"


@dataclass(frozen=True, eq=False)
class Not(Expr):
    """SQL's NOT; with two_valued an unknown argument counts as false, so its negation is true."""

    arg: Expr
    two_valued: bool = False

    def to_column(self) -> Column:
        c = self.arg.to_column()
        return ~(F.coalesce(c, F.lit(False)) if self.two_valued else c)

    def eval_row(self, row):
        v = self.arg.eval_row(row)
        return (not v) if v is not None else True if self.two_valued else None

    def to_sql(self) -> str:
        return f"(NOT COALESCE({self.arg.to_sql()}, FALSE))" if self.two_valued else f"(NOT {self.arg.to_sql()})"


@dataclass(frozen=True, eq=False)
class IsNull(Expr):
    arg: Expr

    def to_column(self) -> Column:
        return self.arg.to_column().isNull()

    def eval_row(self, row):
        return self.arg.eval_row(row) is None

    def to_sql(self) -> str:
        return f"({self.arg.to_sql()} IS NULL)"


@dataclass(frozen=True, eq=False)
class InSet(Expr):
    """Membership in a list of constants. A null in the list is never equal to anything."""

    arg: Expr
    values: tuple

    def to_column(self) -> Column:
        return self.arg.to_column().isin(*[v.to_column() if isinstance(v, Expr) else Lit(v).to_column() for v in self.values]) if self.values else F.lit(False)

    def eval_row(self, row):
        v = self.arg.eval_row(row)
        values = [x.eval_row(row) if isinstance(x, Expr) else x for x in self.values]
        if not values:
            return False
        return None if v is None else True if any(_plain(v) == _plain(x) for x in values if x is not None) else None if None in values else False

    def to_sql(self) -> str:
        return f"({self.arg.to_sql()} IN ({', '.join(lit(v).to_sql() for v in self.values)}))" if self.values else "FALSE"


@dataclass(frozen=True, eq=False)
class InTuples(Expr):
    """Some of the given rows equals these expressions, compared as whole tuples, nulls being equal."""

    args: tuple[Expr, ...]
    rows: tuple[tuple, ...]

    def _expanded(self) -> Expr:
        return any_of(all_of(Cmp("<=>", a, Lit(v)) for a, v in zip(self.args, r, strict=True)) for r in self.rows)

    def to_column(self) -> Column:
        if len(self.args) == 1 and all(r[0] is not None for r in self.rows) and self.rows:
            return F.coalesce(InSet(self.args[0], tuple(r[0] for r in self.rows)).to_column(), F.lit(False))
        return self._expanded().to_column()

    def eval_row(self, row):
        return tuple(_plain(a.eval_row(row)) for a in self.args) in {tuple(map(_plain, r)) for r in self.rows}

    def to_sql(self) -> str:
        return self._expanded().to_sql()


@dataclass(frozen=True, eq=False)
class Contains(Expr):
    """The haystack has the needle as a substring."""

    haystack: Expr
    needle: Expr

    def to_column(self) -> Column:
        return self.haystack.to_column().contains(self.needle.to_column())

    def eval_row(self, row):
        a, b = self.haystack.eval_row(row), self.needle.eval_row(row)
        return None if a is None or b is None else b in a

    def to_sql(self) -> str:
        return f"CONTAINS({self.haystack.to_sql()}, {self.needle.to_sql()})"


@dataclass(frozen=True, eq=False)
class Like(Expr):
    arg: Expr
    pattern: str

    def to_column(self) -> Column:
        return self.arg.to_column().like(self.pattern)

    def eval_row(self, row):
        v = self.arg.eval_row(row)
        parts = re.split("([%_])", self.pattern)
        return None if v is None else bool(re.fullmatch("".join({"%": "(?s:.*)", "_": "(?s:.)"}.get(p, re.escape(p)) for p in parts), v))

    def to_sql(self) -> str:
        return f"({self.arg.to_sql()} LIKE {Lit(self.pattern).to_sql()})"


@dataclass(frozen=True, eq=False)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr

    def _expanded(self) -> Expr:
        return And(Cmp(">=", self.arg, self.low), Cmp("<=", self.arg, self.high))

    def to_column(self) -> Column:
        return self._expanded().to_column()

    def eval_row(self, row):
        return self._expanded().eval_row(row)

    def to_sql(self) -> str:
        return f"({self.arg.to_sql()} BETWEEN {self.low.to_sql()} AND {self.high.to_sql()})"


@dataclass(frozen=True, eq=False)
class Case(Expr):
    """The value of the first condition that holds, else the last one."""

    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr = Lit(None)

    def to_column(self) -> Column:
        (c, v), *more = self.branches
        out = F.when(c.to_column(), v.to_column())
        for c, v in more:
            out = out.when(c.to_column(), v.to_column())
        return out.otherwise(self.otherwise.to_column())

    def eval_row(self, row):
        return next((v.eval_row(row) for c, v in self.branches if c.eval_row(row) is True), self.otherwise.eval_row(row))

    def to_sql(self) -> str:
        return "CASE " + " ".join(f"WHEN {c.to_sql()} THEN {v.to_sql()}" for c, v in self.branches) + f" ELSE {self.otherwise.to_sql()} END"


@dataclass(frozen=True, eq=False)
class Cast(Expr):
    """try_cast: a value that can't be converted becomes null, so a pushed predicate never fails on rows that a filter would have removed."""

    arg: Expr
    to: str

    def to_column(self) -> Column:
        return self.arg.to_column().try_cast(self.to)

    def eval_row(self, row):
        v = self.arg.eval_row(row)
        try:
            if v is None:
                return None
            if self.to in ("int", "bigint", "long"):
                return math.trunc(float(v)) if not isinstance(v, str) else int(v.strip())
            if self.to in ("double", "float"):
                return float(v)
            if self.to == "string":
                return str(v).lower() if isinstance(v, bool) else str(v)
            if self.to == "date":
                return dt.date.fromisoformat(v[:10]) if isinstance(v, str) else v.date() if isinstance(v, dt.datetime) else v
            if self.to.startswith("timestamp"):
                return dt.datetime.fromisoformat(v) if isinstance(v, str) else _plain(v)
        except ValueError:
            return None
        raise NotImplementedError(self.to)

    def to_sql(self) -> str:
        return f"TRY_CAST({self.arg.to_sql()} AS {({'string': 'VARCHAR', 'long': 'BIGINT', 'timestamp_ntz': 'TIMESTAMP'}).get(self.to, self.to.upper())})"


#: Named scalar functions: Spark's, a Python one on values that aren't null, and SQL. More: functions.register.
FUNCTIONS: dict[str, tuple[Callable[..., Column], Callable[..., Any], str]] = {}


@dataclass(frozen=True, eq=False)
class Call(Expr):
    """A registered scalar function. Null if an argument is, except for those of SKIP_NULLS."""

    name: str
    args: tuple[Expr, ...]

    def to_column(self) -> Column:
        return FUNCTIONS[self.name][0](*[a.value if isinstance(a, Lit) and i else a.to_column() for i, a in enumerate(self.args)] if self.name not in _COLUMNS_ONLY else [a.to_column() for a in self.args])

    def eval_row(self, row):
        v = [a.eval_row(row) for a in self.args]
        return None if self.name not in SKIP_NULLS and any(x is None for x in v) else FUNCTIONS[self.name][1](*v)

    def to_sql(self) -> str:
        return FUNCTIONS[self.name][2].format(*[a.to_sql() for a in self.args], all=", ".join(a.to_sql() for a in self.args))


#: Functions whose later arguments may be columns too.
_COLUMNS_ONLY = {"coalesce", "concat", "least", "greatest"}
#: Functions that pass over null arguments.
SKIP_NULLS = {"coalesce", "least", "greatest"}


@dataclass(frozen=True, eq=False)
class Opaque(Expr):
    """A Python function of columns, run on Arrow batches; it gets pandas series and returns one.

    If it says it is deterministic, predicates on its result can be pushed by
    evaluating it on the input; otherwise they are blocked.
    """

    fn: Callable
    args: tuple[Expr, ...]
    returns: str
    pure: bool = True

    def to_column(self) -> Column:
        udf = F.pandas_udf(self.fn, self.returns)
        return (udf if self.pure else udf.asNondeterministic())(*[a.to_column() for a in self.args])

    def eval_row(self, row):
        import pandas as pd

        out = self.fn(*[pd.Series([a.eval_row(row)]) for a in self.args])[0]
        return None if pd.isna(out) else out

    def to_sql(self) -> str:
        raise NotImplementedError("a Python function has no SQL")

    def deterministic(self) -> bool:
        return self.pure and super().deterministic()


TRUE, FALSE = Lit(True), Lit(False)


def all_of(parts: Iterable[Expr]) -> Expr:
    """Conjunction; of nothing it is true."""
    out: Expr | None = None
    for p in parts:
        out = p if out is None else And(out, p)
    return TRUE if out is None else out


def any_of(parts: Iterable[Expr]) -> Expr:
    """Disjunction; of nothing it is false."""
    out: Expr | None = None
    for p in parts:
        out = p if out is None else Or(out, p)
    return FALSE if out is None else out


def row_predicate(row: Mapping[str, Any] | T.Row, columns: Sequence[str] | None = None) -> Expr:
    """The predicate that selects a row of output: null-safe equality on each of the columns."""
    values = row.asDict() if isinstance(row, T.Row) else dict(row)
    return all_of(Cmp("<=>", Field(c), Lit(values[c])) for c in (columns or values))
