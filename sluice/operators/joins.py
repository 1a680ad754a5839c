"""Operators over several inputs: joins and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..predicate import FALSE, TRUE, And, Expr, Field, Lit, all_of, implied_pins, nnf, pinned, simplify, split_and, truth, weaken
from .base import LINEAGE, Node, Push, Status, carried, data_columns, dealt, name

_R = "__right_"
_K = "__key_"
#: log2 of the most rows of a list of a join of few keys.
LIST_BITS = 8


class Join(Node):
    """Equi-join on pairs of columns, with an optional further condition on the output's names.

    Columns that both sides have, other than a key of the same name, get suffixes _x and
    _y. A key of the same name is one column. how: inner, left, right, full. null_safe:
    null keys match, as they do in a data frame merge; SQL's equality otherwise. The
    physical strategy is left to the optimizer, which broadcasts a side only below its
    size limit and splits skewed keys at run time. few_keys: the left rows are dealt over
    all tasks first, for keys of so few values that the pairs are far more than the rows;
    by its bytes alone the left side would be a task or two. An inner join deals lists of
    rows of a key: a list's rows come for one right row after the other, and such runs
    take a fraction of the disk where pairs are written.
    """

    def __init__(self, left: Node, right: Node, cols_left: Sequence[str], cols_right: Sequence[str] | None = None, how: str = "inner", null_safe: bool = False, condition: Expr | None = None, few_keys: bool = False):
        super().__init__(left, right)
        self.few_keys = few_keys
        self.on = list(zip(cols_left, cols_right or cols_left, strict=True))
        self.how, self.null_safe, self.condition = how, null_safe, condition
        if condition is not None and how != "inner":
            raise ValueError("a further condition needs an inner join; filter a side before an outer one")

    def names(self, columns: Sequence[Sequence[str]]) -> tuple[dict[str, str], dict[str, str]]:
        """Output name of each column of either side."""
        left, right = columns
        same = {a for a, b in self.on if a == b}
        both = (set(left) & set(right)) - same
        return {c: f"{c}_x" if c in both else c for c in left}, {c: f"{c}_y" if c in both else c for c in right}

    def _joined(self, l: DataFrame, r: DataFrame, lineage: bool) -> DataFrame:
        columns = data_columns(l), data_columns(r)
        ln, rn = self.names(columns)
        l = l.select(*[name(c).alias(ln[c]) for c in columns[0]], *carried(l))
        lists = self.few_keys and self.how == "inner" and not lineage and bool(self.on)
        if lists:
            l = self._in_lists(l, [ln[a] for a, _ in self.on])
        l = dealt(l) if self.few_keys else l
        r = r.select(*[name(c).alias(_R + rn[c]) for c in columns[1]], *[c.alias(_R + LINEAGE) for c in carried(r)])
        test: Column | None = None
        for a, b in self.on:
            x, y = name(_K + ln[a] if lists else ln[a]), name(_R + rn[b])
            t = x.eqNullSafe(y) if self.null_safe else x == y
            test = t if test is None else test & t
        out = l.join(r, test, {"full": "full_outer"}.get(self.how, self.how)) if test is not None else l.crossJoin(r)
        if lists:
            out = out.select(F.inline("__rows"), *[name(_R + rn[c]) for c in columns[1]])
        same = {a for a, b in self.on if a == b}
        merged = [(F.coalesce(name(ln[c]), name(_R + rn[c])).alias(ln[c]) if c in same and self.how in ("right", "full") else name(ln[c])) for c in columns[0]]
        keep = [*merged, *[name(_R + rn[c]).alias(rn[c]) for c in columns[1] if c not in same]]
        if lineage:
            none = F.array().cast("array<struct<source:string,rid:string>>")
            keep.append(F.concat(F.coalesce(F.col(LINEAGE), none), F.coalesce(F.col(_R + LINEAGE), none)).alias(LINEAGE))
        out = out.select(*keep)
        return out.filter(self.condition.to_column()) if self.condition is not None else out

    @staticmethod
    def _in_lists(l: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows of equal keys near each other as lists, beside their keys; an id's high bits are those of its task."""
        block = F.shiftright(F.monotonically_increasing_id(), LIST_BITS).alias("__block")
        l = l.select(F.struct(*[name(c) for c in data_columns(l)]).alias("__row"), *[name(c).alias(_K + c) for c in dict.fromkeys(keys)], block)
        return l.groupBy("__block", *[name(_K + c) for c in dict.fromkeys(keys)]).agg(F.collect_list("__row").alias("__rows")).drop("__block")

    def build(self, left, right):
        return self._joined(left, right, False)

    def track(self, left, right):
        return self._joined(left, right, True)

    def push(self, f, columns, out):
        ln, rn = self.names(columns)
        pairs = [(ln[a], rn[b]) for a, b in self.on]
        full = simplify(And(f, self.condition)) if self.condition is not None else f
        optional = self.how in ("right", "full"), self.how in ("left", "full")
        same = {ln[a] for a, b in self.on if a == b}
        # A null in an optional side's key may mean that there was no match, which says nothing of the other key.
        asked = [{c for c in own.values() if c not in same} if may else set() for own, may in zip((ln, rn), optional, strict=True)]
        telling = [all_of(q for q in split_and(nnf(full)) if not q.columns() & asked[side] or _rejects_null(q)) for side in (0, 1)]
        fixed = pinned(f)
        key_fixed = all(a in pinned(telling[0]) or b in pinned(telling[1]) for a, b in pairs)
        # An atom on both sides can be asked of one side only where the other's columns are given.
        values = {q.left.name: q.right for q in _equalities(nnf(full)) if q.right.value is not None}
        crossing = [q for q in split_and(nnf(full)) if not any(q.columns() <= set(own.values()) for own in (ln, rn))]
        bounded = [q for q in crossing if not q.columns() <= fixed] if self.how == "inner" else []
        decided = key_fixed and all(q.columns() <= fixed or (self.how == "inner" and any(q.columns() - values.keys() <= set(own.values()) for own in (ln, rn))) for q in crossing)
        pushes = []
        for side, (own, other) in enumerate(((ln, rn), (rn, ln))):
            mine = set(own.values())
            gone = set(out) - mine | (set(other.values()) - mine)
            back = {new: Field(old) for old, new in own.items()}
            implied = weaken(implied_pins(telling[1 - side], pairs), gone)
            reach = weaken(all_of(q.substitute({c: values[c] for c in q.columns() - mine if c in values}) for q in bounded), gone)
            local = simplify(all_of([weaken(full, gone), implied, reach]))
            # A padded row keeps no trace of what this side lacked: prune an optional side by its key alone.
            key_only = simplify(And(implied, weaken(telling[side], gone | (mine - {p[side] for p in pairs}))))
            kept_side = optional[1 - side]
            if decided:
                status, reason = Status.EXACT, ""
            elif kept_side and full.columns() <= mine - ({p[side] for p in pairs} if self.how == "full" else set()):
                status, reason = Status.EXACT, ""  # every row of this side comes through, and nothing else is asked
            else:
                status, reason = Status.SUPERSET, f"{self!r}: a join key is not fixed"
            prune = key_only if optional[side] else local
            pushes.append(Push(local.substitute(back), status, reason, prune.substitute(back)))
        return pushes

    def decided_by(self, i, f, columns):
        # Then every row asked for meets the rows of the other side that are part of a row that f is true of.
        sides = [set(names.values()) for names in self.names(columns)]
        if self.how != "inner" or self.condition is not None or not all(any(q.columns() <= side for side in sides) for q in split_and(nnf(f))):
            return None
        return frozenset(pair[i] for pair in self.on)

    def comes_from(self, column, columns):
        ln, rn = self.names(columns)
        for i, own in enumerate((ln, rn)):
            old = next((c for c in columns[i] if own[c] == column), None)
            # The values of an optional side's columns may be padding.
            if old is not None:
                return (i, old, True) if self.how in ("inner", ("left", "right")[i]) else None
        return None

    def required(self, i):
        return self.how == "inner" or self.how == ("left", "right")[i]

    def keys(self, keys, columns):
        ln, rn = self.names(columns)
        left = {frozenset(ln[c] for c in k) for k in keys[0]}
        right = {frozenset(rn[c] for c in k) for k in keys[1]}
        lk, rk = frozenset(ln[a] for a, _ in self.on), frozenset(rn[b] for _, b in self.on)
        out: set[frozenset[str]] = set()
        if self.on and any(k <= rk for k in right) and self.how in ("inner", "left"):
            out |= left
        if self.on and any(k <= lk for k in left) and self.how in ("inner", "right"):
            out |= right
        return out or ({a | b for a in left for b in right} if self.how == "inner" else set())


def _rejects_null(q: Expr) -> bool:
    """Whether an atom on one column is not true of a null."""
    try:
        return truth(q.substitute(dict.fromkeys(q.columns(), Lit(None)))) is not True
    except Exception:  # a function may not take an untyped null; then nothing is claimed
        return False


class InnerJoin(Join):
    def __init__(self, left: Node, right: Node, cols_left: Sequence[str], cols_right: Sequence[str] | None = None, **kw):
        super().__init__(left, right, cols_left, cols_right, how="inner", **kw)


class LeftOuterJoin(Join):
    def __init__(self, left: Node, right: Node, cols_left: Sequence[str], cols_right: Sequence[str] | None = None, **kw):
        super().__init__(left, right, cols_left, cols_right, how="left", **kw)


class CrossJoin(Join):
    """Every pair of rows; meant for a right side of one row or a few."""

    def __init__(self, left: Node, right: Node):
        super().__init__(left, right, [], [])

    def push(self, f, columns, out):
        pushes, sides = super().push(f, columns, out), [set(own.values()) for own in self.names(columns)]
        # Each side's rows meet all of the other's: only what f asks of the other side, or of both, may be missing.
        apart = all(any(q.columns() <= side for side in sides) for q in split_and(nnf(f)))
        return [Push(p.predicate) if apart else p for p in pushes]


class SemiJoin(Node):
    """Rows of the left side with a match on the right: EXISTS and IN.

    condition: a further test on left columns and right ones, the latter as
    `right.<column>`; it needs an equi-join key beside it.
    """

    anti = False

    def decided_by(self, i, f, columns):
        return frozenset(pair[i] for pair in self.on) if not self.anti and self.condition is None else None

    def comes_from(self, column, columns):
        return (0, column, True) if column in columns[0] else None

    def required(self, i):
        return i == 0 or not self.anti

    def __init__(self, left: Node, right: Node, cols_left: Sequence[str], cols_right: Sequence[str] | None = None, condition: Expr | None = None):
        super().__init__(left, right)
        self.on = list(zip(cols_left, cols_right or cols_left, strict=True))
        self.condition = condition

    def _sides(self, left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
        r = right.select(*[name(c).alias(f"right.{c}") for c in data_columns(right)], *[c.alias(_R + LINEAGE) for c in carried(right)])
        test = F.lit(True)
        for a, b in self.on:
            test = test & (name(a) == name(f"right.{b}"))
        return r, test & self.condition.to_column() if self.condition is not None else test

    def build(self, left, right):
        r, test = self._sides(left, right)
        return left.join(r, test, "left_anti" if self.anti else "left_semi")

    def track(self, left, right):
        if self.anti:
            return self.build(left, right)
        r, test = self._sides(left, right)
        columns = data_columns(left)
        out = left.select(*[name(c) for c in columns], F.col(LINEAGE), F.to_json(LINEAGE).alias("__own")).join(r, test)
        # Matches gather by the left row, which its lineage identifies; equal rows stay apart.
        return out.groupBy(*[name(c) for c in columns], "__own").agg(F.first(LINEAGE).alias("__mine"), F.flatten(F.collect_list(_R + LINEAGE)).alias("__theirs")).select(*[name(c) for c in columns], F.concat("__mine", "__theirs").alias(LINEAGE))

    def refer(self, refs, left, right):
        if self.anti:
            return self.build(left, right)
        r, test = self._sides(left, right)
        need = sorted({a for a, _ in self.on} | ({c for c in self.condition.columns() if not c.startswith("right.")} if self.condition is not None else set()))

        def members(keys: DataFrame) -> DataFrame:
            return keys.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(need)]).join(r, test).select(F.col(_R + LINEAGE).alias(LINEAGE))

        out = left.join(r, test, "left_semi")
        return out.select(*[name(c) for c in data_columns(left)], F.concat(LINEAGE, refs.to(out, need, members)).alias(LINEAGE))

    def push(self, f, columns, out):
        fixed = pinned(f)
        need = {a for a, _ in self.on} | ({c for c in self.condition.columns() if not c.startswith("right.")} if self.condition is not None else set())
        status = Status.EXACT if need <= fixed else Status.SUPERSET
        reason = "" if status == Status.EXACT else f"{self!r}: a correlated column is not fixed"
        carried_over = implied_pins(f, [(a, f"\x00{b}") for a, b in self.on])
        right = weaken(carried_over, set(columns[0])).substitute({f"\x00{b}": Field(b) for _, b in self.on})
        match = right
        if self.condition is not None:
            values = {q.left.name: q.right for q in _equalities(f)}
            bound = self.condition.substitute({**values, **{f"right.{c}": Field(f"\x00{c}") for c in columns[1]}})
            loose = {c for c in bound.columns() if not c.startswith("\x00")}
            bound = weaken(bound, loose).substitute({f"\x00{c}": Field(c) for c in columns[1]})
            match = simplify(And(right, bound))
        if self.anti:  # absence has no rows; the other side still decides who stays
            return [Push(f, status, reason), Push(FALSE, Status.EXACT, "", right)]
        return [Push(f, status, reason), Push(match, status, reason, right)]


def _equalities(f: Expr):
    from ..predicate import Cmp, split_and

    for q in split_and(f):
        if isinstance(q, Cmp) and q.op in ("==", "<=>") and isinstance(q.left, Field) and isinstance(q.right, Lit):
            yield q


class AntiJoin(SemiJoin):
    """Rows of the left side without a match on the right: NOT EXISTS."""

    anti = True


class NotIn(AntiJoin):
    """SQL's NOT IN on one column: no row if the right side has a null, no null on the left unless the right side is empty."""

    def __init__(self, left: Node, right: Node, col_left: str, col_right: str | None = None):
        super().__init__(left, right, [col_left], [col_right or col_left])

    def build(self, left, right):
        (a, b), = self.on
        r = right.select(name(b).alias("__in"))
        state = r.agg(F.count(F.lit(1)).alias("__rows"), F.count_if(F.col("__in").isNull()).alias("__nulls"))
        kept = left.join(r, name(a) == F.col("__in"), "left_anti").crossJoin(F.broadcast(state))  # the state is one row
        return kept.filter((F.col("__rows") == 0) | ((F.col("__nulls") == 0) & name(a).isNotNull())).drop("__rows", "__nulls")

    def push(self, f, columns, out):
        left, right = super().push(f, columns, out)
        return [left, Push(FALSE, Status.EXACT, "", TRUE)]


class Append(Node):
    """The rows of all inputs, columns matched by name; a column an input lacks is null in its rows."""

    def __init__(self, deps: Sequence[Node]):
        super().__init__(*deps)

    def build(self, *frames):
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        own = [c for c in out.columns if c != LINEAGE]
        return out.select(*[name(c) for c in own], *carried(out))

    def push(self, f, columns, out):
        return [Push(simplify(f.substitute({c: Lit(None) for c in out if c not in own}))) for own in columns]

    def required(self, i):
        return len(self.inputs) == 1

    def keys(self, keys, columns):
        return keys[0] if len(keys) == 1 else set()


class ConcatColumn(Join):
    """Columns of the inputs side by side, rows aligned by the columns `on`, which identify a row in either."""

    def __init__(self, left: Node, right: Node, on: Sequence[str], how: str = "inner"):
        super().__init__(left, right, on, on, how=how, null_safe=True)


class Combine(Node):
    """Rows aligned by `on` as in a full join; each other column is combine(left, right) of the two sides' values.

    combine: an expression of the columns `l` and `r`; the default takes the left value unless it is null.
    """

    def __init__(self, left: Node, right: Node, on: Sequence[str], combine: Expr | None = None):
        from ..functions import call

        super().__init__(left, right)
        self.on, self.combine = list(on), combine if combine is not None else call("coalesce", Field("l"), Field("r"))
        self.join = Join(left, right, on, on, how="full", null_safe=True)

    def _combined(self, joined: DataFrame, columns) -> DataFrame:
        ln, rn = self.join.names(columns)
        keep = [name(c) for c in self.on]
        for c in dict.fromkeys([*columns[0], *columns[1]]):
            if c in self.on:
                continue
            l = Field(ln[c]) if c in ln else Lit(None)
            r = Field(rn[c]) if c in rn else Lit(None)
            keep.append(self.combine.substitute({"l": l, "r": r}).to_column().alias(c))
        return joined.select(*keep, *carried(joined))

    def build(self, left, right):
        return self._combined(self.join.build(left, right), (data_columns(left), data_columns(right)))

    def track(self, left, right):
        return self._combined(self.join.track(left, right), (data_columns(left), data_columns(right)))

    def push(self, f, columns, out):
        key = weaken(f, set(out) - set(self.on))
        exact = set(self.on) <= pinned(f)
        return [Push(key, Status.EXACT if exact else Status.SUPERSET, "" if exact else "Combine: the alignment is not fixed")] * 2

    def required(self, i):
        return False

    def keys(self, keys, columns):
        return {frozenset(self.on)}


__all__ = ["AntiJoin", "Append", "Combine", "ConcatColumn", "CrossJoin", "InnerJoin", "Join", "LeftOuterJoin", "NotIn", "SemiJoin", "all_of"]
