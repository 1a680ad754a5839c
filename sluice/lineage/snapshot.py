"""Snapshots of intermediate results: where they are needed, what they hold, how they are used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import CrosstableUDF, DropDuplicate, GroupBy, GroupedMap, IntervalJoin, Join, Pivot, SemiJoin
from ..operators.base import Node, Status, name
from ..pipeline import Pipeline
from ..predicate import TRUE, Cmp, Expr, Field, InTuples, Lit, all_of
from ..sources.tables import write_parquet
from .pushdown import push_down


@dataclass(frozen=True)
class Planned:
    """A snapshot of a node's output: the columns to store."""

    node: Node
    columns: tuple[str, ...]


def needed(node: Node, columns: list[str], pipeline: Pipeline) -> set[str]:
    """Columns of a node's output that, once fixed, make its pushes exact."""
    if isinstance(node, Join):
        ln, rn = node.names([pipeline.columns(i) for i in node.inputs])
        extra = node.condition.columns() if node.condition is not None else set()
        place = {ln[node.point]} if isinstance(node, IntervalJoin) else set()
        return {ln[a] for a, _ in node.on} | set(extra) | place
    if isinstance(node, (GroupBy, GroupedMap)):
        return set(node.by)
    if isinstance(node, Pivot):
        return set(node.index)
    if isinstance(node, DropDuplicate):
        return set(columns)
    if isinstance(node, SemiJoin):
        extra = {c for c in node.condition.columns() if not c.startswith("right.")} if node.condition is not None else set()
        return {a for a, _ in node.on} | extra
    if isinstance(node, CrosstableUDF):
        return {c for q in node.queries for c in q.outer_columns()} | {c for p in node.paths for c in p.condition.columns()}
    return set()


def plan_snapshots(pipeline: Pipeline, key: list[str] | None = None) -> list[Planned]:
    """Where a lineage look-up for one row of the result, known by its key columns, needs a snapshot.

    Pushes a symbolic row downwards. At an operator that it leaves inexact, the columns
    that would fix it are to be stored, with those that tell which stored rows belong to
    the row that is asked about; with them the pass goes on as if they were known.
    """
    keys = pipeline.unique_keys()
    columns = key or sorted(min(keys[pipeline.sink], key=len, default=frozenset(pipeline.columns(pipeline.sink)))) or pipeline.columns(pipeline.sink)
    f = all_of(Cmp("<=>", Field(c), Lit("?")) for c in columns)
    plan: list[Planned] = []
    extra: dict[Node, Expr] = {}
    for node in reversed(pipeline.nodes):
        want = needed(node, pipeline.columns(node), pipeline)
        if not want:
            continue
        pushed = push_down(pipeline, f, extra)
        me = pushed[node]
        asked = me.predicate.columns()
        if want <= _fixed(me.predicate) or me.status == Status.BLOCKED:
            continue
        down = node.push(me.predicate, [pipeline.columns(i) for i in node.inputs], pipeline.columns(node))
        if all(p.status == Status.EXACT for p in down):
            continue
        plan.append(Planned(node, tuple(c for c in pipeline.columns(node) if c in want | asked)))
        extra[node] = all_of(Cmp("<=>", Field(c), Lit("?")) for c in sorted(want))
    return plan


def _fixed(p: Expr) -> frozenset[str]:
    from ..predicate import pinned

    return pinned(p)


class SnapshotStore:
    """Snapshots of a pipeline, written once beside a run and looked up for each question.

    most_rows: of a snapshot's rows that belong to a question, as many as go into a
    predicate; beyond that the look-up leaves the push a superset.
    """

    def __init__(self, path: str, most_rows: int = 1000):
        self.path, self.most_rows = path.rstrip("/"), most_rows
        self.stored: list[tuple[Planned, DataFrame]] = []

    def build(self, pipeline: Pipeline, key: list[str] | None = None) -> list[Planned]:
        """Plan and write; distinct rows of the stored columns only."""
        plan = plan_snapshots(pipeline, key)
        for i, p in enumerate(plan):
            rows = pipeline.frame(p.node).select(*[name(c) for c in p.columns]).distinct()
            self.stored.append((p, write_parquet(rows, f"{self.path}/snapshot_{i}")))
        return plan

    def known(self, pipeline: Pipeline, f: Expr) -> dict[Node, Expr]:
        """For stored nodes, the tuples that the rows asked about have there."""
        out: dict[Node, Expr] = {}
        for p, df in self.stored:
            asked = push_down(pipeline, f, out)[p.node].predicate
            if not asked.columns() <= set(p.columns):
                continue
            rows = df.filter(asked.to_column()).limit(self.most_rows + 1).collect()
            if len(rows) <= self.most_rows:
                out[p.node] = InTuples(tuple(Field(c) for c in p.columns), tuple(tuple(r) for r in rows)) if rows else TRUE
        return out
