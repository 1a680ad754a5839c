"""Joins along an order: points in intervals, and the latest row before each one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..predicate import Field, Lit, all_of, implied_pins, nnf, pinned, simplify, split_and, weaken
from ..predicate import And, Cmp, Expr
from .base import LINEAGE, Node, Push, Status, carried, data_columns, dealt, name
from .joins import _R, Join

_LARGEST = 1.7976931348623157e308


def measure(df: DataFrame, column: str) -> Column:
    """A column's place on a line, as a double that grows with it."""
    kind, c = df.schema[column].dataType, name(column)
    if isinstance(kind, T.TimestampNTZType):  # not by way of a time zone, whose hours jump
        c = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"{column}: no place on a line for {kind.simpleString()}")
    return F.greatest(F.least(c.cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST))


class IntervalJoin(Join):
    """Pairs of a left row and a right one in whose interval the left point lies: low <= point <= high; closed=False leaves out high.

    by: pairs of columns that must be equal too. A null or NaN in point, low or high, or
    a low above high, meets nothing. An interval stands in the bins of a width that is
    the power of two next to its length, of which it touches two or three; a point is
    looked up once for each width that occurs. So every pair meets in one bin, in an
    equi-join that Spark plans and splits like any other, and neither side is multiplied
    by how long its intervals are. The widths are one row of at most about 2,100 numbers.
    """

    def __init__(self, left: Node, right: Node, point: str, low: str, high: str, by: Sequence[tuple[str, str]] = (), closed: bool = True):
        super().__init__(left, right, [a for a, _ in by], [b for _, b in by])
        self.point, self.low, self.high, self.closed = point, low, high, closed

    def _inside(self, point: Expr, low: Expr, high: Expr) -> Expr:
        return And(Cmp("<=", low, point), Cmp("<=" if self.closed else "<", point, high))

    def _joined(self, l: DataFrame, r: DataFrame, lineage: bool) -> DataFrame:
        columns = data_columns(l), data_columns(r)
        ln, rn = self.names(columns)
        real = lambda df, *cols: [c for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
        for c in real(l, self.point):
            l = l.filter(~F.isnan(name(c)))
        for c in real(r, self.low, self.high):
            r = r.filter(~F.isnan(name(c)))
        r = r.filter((name(self.low) <= name(self.high)) if self.closed else (name(self.low) < name(self.high))).withColumns({"__low": measure(r, self.low), "__high": measure(r, self.high)})
        # Never narrower than what a double tells apart there.
        length = F.greatest(F.col("__high") - F.col("__low"), F.greatest(F.abs("__high"), F.abs("__low")) * 2.0**-50, F.lit(2.0**-1000))
        r = r.withColumn("__level", F.least(F.ceil(F.log2(length)), F.lit(1023)).cast("int"))
        levels = r.agg(F.collect_set("__level").alias("__levels"))
        at = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("__level")))
        # A row may meet any number of others, so the bytes of a side don't say what work there is.
        r = dealt(r).withColumn("__bin", F.explode(F.sequence(at(F.col("__low")), at(F.col("__high")))))
        l = dealt(l.filter(name(self.point).isNotNull())).withColumn("__point", measure(l, self.point)).crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).withColumn("__bin", at(F.col("__point")))
        l = l.select(*[name(c).alias(ln[c]) for c in columns[0]], *carried(l), F.col("__level").alias("__at"), F.col("__bin").alias("__in"))
        r = r.select(*[name(c).alias(_R + rn[c]) for c in columns[1]], *[c.alias(_R + LINEAGE) for c in carried(r)], "__level", "__bin")
        test = (F.col("__at") == F.col("__level")) & (F.col("__in") == F.col("__bin"))
        for a, b in self.on:
            test = test & (name(ln[a]) == name(_R + rn[b]))
        out = l.join(r, test & self._inside(Field(ln[self.point]), Field(_R + rn[self.low]), Field(_R + rn[self.high])).to_column())
        same = {a for a, b in self.on if a == b}
        keep = [name(ln[c]) for c in columns[0]] + [name(_R + rn[c]).alias(rn[c]) for c in columns[1] if c not in same]
        return out.select(*keep, *([F.concat(LINEAGE, _R + LINEAGE).alias(LINEAGE)] if lineage else []))

    def push(self, f, columns, out):
        ln, rn = self.names(columns)
        point, low, high = ln[self.point], rn[self.low], rn[self.high]
        given = {q.left.name: q.right for q in split_and(nnf(f)) if isinstance(q, Cmp) and q.op in ("==", "<=>") and isinstance(q.left, Field) and isinstance(q.right, Lit) and q.right.value is not None}
        sides = [set(ln.values()), set(rn.values())]
        apart = all(any(q.columns() <= s for s in sides) for q in split_and(nnf(f)))
        fixed = pinned(f, one=True)
        equal = all(ln[a] in fixed or rn[b] in fixed for a, b in self.on)
        exact = equal and apart and (point in given or {low, high} <= given.keys())
        pushes = []
        for side, (own, other) in enumerate(((ln, rn), (rn, ln))):
            mine = set(own.values())
            gone = set(out) - mine | (set(other.values()) - mine)
            local = And(weaken(f, gone), weaken(implied_pins(f, [(ln[a], rn[b]) for a, b in self.on]), gone))
            # What is given of the other side bounds this one.
            reach = weaken(self._inside(*[given.get(c, Field(c)) if c not in mine else Field(c) for c in (point, low, high)]), gone)
            p = simplify(And(local, reach)).substitute({new: Field(old) for old, new in own.items()})
            pushes.append(Push(p, Status.EXACT if exact else Status.SUPERSET, "" if exact else "IntervalJoin: neither the point nor the interval is fixed"))
        return pushes

    def decided_by(self, i, f, columns):
        return None

    def keys(self, keys, columns):
        ln, rn = self.names(columns)
        return {frozenset(ln[c] for c in a) | frozenset(rn[c] for c in b) for a in keys[0] for b in keys[1]}


class AsOfJoin(Node):
    """Each left row with the latest right row of the same `by` whose time isn't after its own; nulls where there is none.

    strict: it must be before. Right rows of one time: the last by all columns counts. A
    null in time or by meets nothing. Columns of the right side that the left has too get
    the suffix _y. Both sides are laid out in ranges of (by, time) which are written once,
    as their bounds are sampled; within a range the last right row is carried along, and
    the first key of a range gets what the ranges before it ended with: one row for each
    of at most `ranges`. So a key that holds any share of the rows is spread.
    """

    def __init__(self, left: Node, right: Node, left_time: str, right_time: str, by: Sequence[tuple[str, str]] = (), strict: bool = False, ranges: int = 64):
        super().__init__(left, right)
        self.left_time, self.right_time, self.by, self.strict, self.ranges = left_time, right_time, list(by), strict, ranges

    def names(self, columns: Sequence[Sequence[str]]) -> dict[str, str]:
        """Output name of each right column; those equated with a left column of the same name go."""
        same = {b for a, b in self.by if a == b}
        return {c: f"{c}_y" if c in columns[0] else c for c in columns[1] if c not in same}

    def build(self, left, right):
        from ..sources.scratch import stored

        columns, names = (data_columns(left), data_columns(right)), self.names((data_columns(left), data_columns(right)))
        tracked = bool(carried(left))
        right = right.filter(name(self.right_time).isNotNull())
        for _, b in self.by:
            right = right.filter(name(b).isNotNull())
        keys = [f"__k{i}" for i in range(len(self.by))]
        # At one time right rows come first, or last where they must be earlier.
        mine = left.select(*[name(a).alias(k) for k, (a, _) in zip(keys, self.by, strict=True)], name(self.left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[name(c) for c in columns[0]], *carried(left)).alias("__l"))
        theirs = right.select(*[name(b).alias(k) for k, (_, b) in zip(keys, self.by, strict=True)], name(self.right_time).alias("__t"), F.lit(2 if self.strict else 0).alias("__side"), F.struct(*[name(c) for c in columns[1]], *carried(right)).alias("__r"))
        both = mine.unionByName(theirs, allowMissingColumns=True)
        d = stored(both.repartitionByRange(self.ranges, *[F.col(k).asc_nulls_last() for k in keys], F.col("__t").asc_nulls_last(), "__side").withColumn("__range", F.spark_partition_id()), "asof")
        whole = F.struct(*keys, F.lit(0).alias("__one")).alias("__key")
        ranked = F.struct(F.col("__t"), F.col("__r"))
        # Of each range: its first and last key, and the last right row of the last one.
        ends = d.groupBy("__range", whole).agg(F.max(F.when(F.col("__r").isNotNull(), ranked)).alias("__last"))
        ends = ends.groupBy("__range").agg(F.min("__key").alias("__first"), F.max(F.struct("__key", "__last")).alias("__end"))
        before = ends.select(F.col("__range").alias("__earlier"), F.col("__end.__key").alias("__ended"), F.col("__end.__last.__r").alias("__carry")).filter(F.col("__carry").isNotNull())
        into = ends.select(F.col("__range").alias("__of"), "__first").join(before, (F.col("__first") == F.col("__ended")) & (F.col("__earlier") < F.col("__of")))
        into = into.groupBy("__of").agg(F.first("__first").alias("__first"), F.max_by("__carry", "__earlier").alias("__carry"))
        w = Window.partitionBy("__range", *keys).orderBy(F.col("__t").asc_nulls_last(), F.col("__side"), F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn("__met", F.last("__r", ignorenulls=True).over(w)).filter(F.col("__l").isNotNull())
        d = d.join(F.broadcast(into), (F.col("__range") == F.col("__of")) & (F.struct(*keys, F.lit(0).alias("__one")) == F.col("__first")), "left")
        met = F.when(F.col("__t").isNotNull(), F.coalesce("__met", "__carry"))
        d = d.select("__l", met.alias("__r"))
        out = [F.col("__l").getField(c).alias(c) for c in columns[0]] + [F.col("__r").getField(c).alias(names[c]) for c in columns[1] if c in names]
        if tracked:
            none = F.array().cast("array<struct<source:string,rid:string>>")
            out.append(F.concat(F.col("__l").getField(LINEAGE), F.coalesce(F.col("__r").getField(LINEAGE), none)).alias(LINEAGE))
        return d.select(*out)

    def push(self, f, columns, out):
        names = self.names(columns)
        left = weaken(f, set(out) - set(columns[0]))
        mine = Push(left) if f.columns() <= set(columns[0]) else Push(left, Status.SUPERSET, "AsOfJoin: the row that is met decides")
        # Other right rows decide which one is met, so only those of other keys may go.
        key = weaken(implied_pins(f, [(a, f"\x00{b}") for a, b in self.by]), set(columns[0])).substitute({f"\x00{b}": Field(b) for _, b in self.by})
        theirs = all_of(q for q in split_and(nnf(f)) if q.columns() and q.columns() <= set(names.values()) and not _null_test(q))
        theirs = simplify(And(theirs.substitute({new: Field(old) for old, new in names.items()}), key))
        return [mine, Push(theirs, Status.SUPERSET, "AsOfJoin: the latest row depends on the others", key)]

    def required(self, i):
        return i == 0

    def comes_from(self, column, columns):
        return (0, column, True) if column in columns[0] else None

    def keys(self, keys, columns):
        return set(keys[0])


def _null_test(q: Expr) -> bool:
    """Whether a null, which may mean that nothing was met, satisfies an atom."""
    from .joins import _rejects_null

    return not _rejects_null(q)


__all__ = ["AsOfJoin", "IntervalJoin"]
