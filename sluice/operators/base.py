"""What every operator is: a node that builds a DataFrame and pushes predicates to its inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..predicate import TRUE, Expr

#: The column that eager tracking carries: array<struct<source, rid>>.
LINEAGE = "__lineage"
#: The column with a source row's identity.
RID = "__rid"


class Status(IntEnum):
    """How good a pushed predicate is. EXACT: it selects the lineage. SUPERSET: more. BLOCKED: it says nothing."""

    EXACT = 0
    SUPERSET = 1
    BLOCKED = 2


@dataclass(frozen=True)
class Push:
    """What an operator asks of one input.

    predicate selects at least the lineage; prune may be applied to the input without
    changing the selected output rows (the same, unless rows outside the lineage decide
    about them, as they do below a limit).
    """

    predicate: Expr
    status: Status = Status.EXACT
    reason: str = ""
    prune: Expr | None = None

    @property
    def pruning(self) -> Expr:
        return self.predicate if self.prune is None else self.prune


class Node:
    """An operator over inputs. Subclasses say how to build, push, track and which keys they have."""

    def __init__(self, *inputs: Node):
        self.inputs: tuple[Node, ...] = inputs

    def build(self, *frames: DataFrame) -> DataFrame:
        """The operator over the frames of its inputs; a lineage column, where there is one, is carried along."""
        raise NotImplementedError

    def track(self, *frames: DataFrame) -> DataFrame:
        """The operator over frames that have the lineage column. As build, for operators that keep rows apart."""
        return self.build(*frames)

    def refer(self, refs: References, *frames: DataFrame) -> DataFrame:
        """As track, but a row that gathers others carries a reference to them, which refs resolves. For operators that gather nothing, track itself."""
        return self.track(*frames)

    def push(self, f: Expr, columns: Sequence[Sequence[str]], out: Sequence[str]) -> list[Push]:
        """For each input, the predicate on it that f on the output comes down to.

        columns: of each input; out: of the output.
        """
        raise NotImplementedError

    def required(self, i: int) -> bool:
        """Whether every output row is made from at least one row of input i."""
        return True

    def updated(self) -> frozenset[str]:
        """Columns that the operator makes or overwrites, known from the operator and not from schemas."""
        return frozenset()

    def comes_from(self, column: str, columns: Sequence[Sequence[str]]) -> tuple[int, str, bool] | None:
        """(input, its column, apart) whose values an output column holds; None if it holds others too.

        apart: input rows may be left out by that column's values, and then just the output
        rows with those values are missing.
        """
        return None

    def decided_by(self, i: int, f: Expr, columns: Sequence[Sequence[str]]) -> frozenset[str] | None:
        """Columns of input i: where the predicate pushed to it fixes them to one value each, known or not, it is exact.

        It may be taken for granted that some output row satisfies f. None: that is not enough.
        """
        return None

    def keys(self, keys: Sequence[set[frozenset[str]]], columns: Sequence[Sequence[str]]) -> set[frozenset[str]]:
        """Unique keys of the output, from those of the inputs."""
        changed = self.updated()
        return {k for k in keys[0] if not k & changed} if keys else set()

    def __repr__(self) -> str:
        return type(self).__name__


def name(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def carried(df: DataFrame) -> list[Column]:
    """The lineage column, if the frame has it."""
    return [F.col(LINEAGE)] if LINEAGE in df.columns else []


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (LINEAGE, RID)]


def nothing() -> Push:
    return Push(TRUE, Status.BLOCKED)


def dealt(df: DataFrame) -> DataFrame:
    """df's rows, dealt evenly over a given number of tasks, which aren't merged for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gathered() -> Column:
    """The lineage of all rows of a group, in one array."""
    return F.flatten(F.collect_list(LINEAGE)).alias(LINEAGE)


#: What the source of a reference begins with; no table is named so.
GROUP = "\x00"
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: From a frame of keys __k0, __k1, ..., the rows, with LINEAGE, that belong to any of them.
Members = Callable[[DataFrame], DataFrame]


@dataclass
class Group:
    """What one operator refers to. reach: the tables and other groups that its members may refer to."""

    source: str
    keys: StructType
    members: Members
    reach: set[str] = field(default_factory=set)


class References:
    """Groups of rows that other rows were made from, by reference.

    A row that is made from many rows carries one entry of LINEAGE: the operator's name
    and the key of its group. Only the groups that selected rows refer to are looked up,
    from the last operator to the first, each by a join of its input with those keys. So
    no row and no task holds a group's lineage, however large the group is.
    """

    def __init__(self) -> None:
        self.groups: list[Group] = []

    def to(self, df: DataFrame, columns: Sequence[str], members: Members) -> Column:
        """For df's rows, the lineage column that refers to the group with the row's values of columns."""
        keys = [name(c).alias(f"__k{i}") for i, c in enumerate(columns)] or [F.lit(0).alias("__k0")]
        self.groups.append(Group(f"{GROUP}{len(self.groups)}", df.select(*keys).schema, members))
        return F.array(F.struct(F.lit(self.groups[-1].source).alias("source"), F.to_json(F.struct(*keys), _JSON).alias("rid"))).alias(LINEAGE)

    def resolved(self, rows: DataFrame, tables: Sequence[str]) -> DataFrame:
        """(source, rid) of the rows of tables that rows were made from; some may come twice."""
        from ..sources.scratch import stored

        asked = [g for g in self.groups if g.reach & set(tables)]

        def entries(df: DataFrame) -> DataFrame:
            return df.select(F.explode(LINEAGE).alias("l")).select("l.source", "l.rid").filter(F.col("source").isin([*tables, *[g.source for g in asked]]))

        found = [stored(entries(rows).distinct(), "references") if asked else entries(rows)]
        for g in reversed(asked):
            refs = self._all(found).filter(F.col("source") == g.source)
            more = entries(g.members(refs.select(F.from_json("rid", g.keys, _JSON).alias("k")).select("k.*").distinct()))
            # Read again for the groups that it refers to.
            found.append(stored(more.distinct(), "references") if any(o.source in g.reach for o in asked) else more)
        return self._all(found).filter(F.col("source").isin(list(tables)))

    @staticmethod
    def _all(frames: Sequence[DataFrame]) -> DataFrame:
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out


def members_by(df: DataFrame, columns: Sequence[str]) -> Members:
    """The rows of df whose columns are equal to a key's, nulls too."""

    def members(keys: DataFrame) -> DataFrame:
        test = F.lit(True)
        for i, c in enumerate(columns):
            test = test & name(c).eqNullSafe(F.col(f"__k{i}"))
        return df.join(keys, test, "left_semi") if columns else df.crossJoin(F.broadcast(keys.limit(1)))

    return members
