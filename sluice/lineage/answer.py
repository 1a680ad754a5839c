"""The answer to a lineage question, exact whichever way it takes."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import Filter, TopN
from ..operators.base import RID, Node, Status
from ..pipeline import Pipeline
from ..predicate import FALSE, And, Expr, Lit, any_of, pinned, simplify
from ..sources.scratch import stored
from .pushdown import Pushed, push_down
from .sideways import join_tree, outwards, reduced
from .snapshot import SnapshotStore


@dataclass
class SourceLineage:
    """Of one table: the pushed predicate and its status, why it isn't better, and the rows.

    exact: whether rows are the lineage; a superset is never passed off as it.
    """

    table: str
    predicate: Expr
    status: Status
    reasons: list[str]
    rows: DataFrame
    exact: bool


@dataclass
class Lineage:
    sources: dict[str, SourceLineage]

    def __getitem__(self, table: str) -> SourceLineage:
        return self.sources[table]

    def counts(self) -> dict[str, int]:
        return {t: s.rows.count() for t, s in self.sources.items()}


def without_limits(pipeline: Pipeline, pushed: dict[Node, Pushed]) -> Pipeline:
    """pipeline with a filter in place of each TopN whose row is fixed.

    Below a limit nothing may be pruned, as other rows decide who is among the first. Of
    a row that is known to be among them that is decided, so its lineage can be traced
    through a filter, below which its predicate prunes on.
    """
    fixed = {n: Filter(n.inputs[0], pushed[n].predicate) for n in pipeline.nodes if isinstance(n, TopN) and pushed[n].status == Status.EXACT and set(pipeline.columns(n)) <= pinned(pushed[n].predicate)}
    return pipeline.replacing(fixed) if fixed else pipeline


def lineage(pipeline: Pipeline, f: Expr, mode: str = "auto", snapshots: SnapshotStore | None = None, check_exists: bool = True, tables: Collection[str] | None = None) -> Lineage:
    """The source rows that the result rows selected by f were made from.

    mode: `pushdown` applies the pushed predicates alone and says where they are
    supersets; `auto` narrows those: by semi-joins along the joins where these give the
    lineage, else by running the pipeline, over sources that are pruned and reduced by
    one another, with row identities; `snapshot` first looks up what is missing in snapshots; `eager`
    tracks everything. f is tested to select a row at all (a pushed predicate is only
    right for rows that exist); check_exists=False saves that for a row that was seen. tables: those asked for, by
    default all; nothing is computed for the others.
    """
    if mode not in ("auto", "pushdown", "snapshot", "eager"):
        raise KeyError(mode)
    if mode == "snapshot" and snapshots is None:
        raise ValueError("snapshot mode needs a SnapshotStore")
    if mode == "eager":
        return eager_lineage(pipeline, f, tables)
    pushed = push_down(pipeline, f, snapshots.known(pipeline, f) if mode == "snapshot" else None)
    if check_exists and pipeline.pruned({s: pushed[s].prune for s in pipeline.sources}).filter(f.to_column()).isEmpty():
        pushed = {n: Pushed() for n in pipeline.nodes}
    by_table: dict[str, list[Node]] = {}
    for s in pipeline.sources:
        if tables is None or s.table in tables:
            by_table.setdefault(s.table, []).append(s)
    loose = {t for t, nodes in by_table.items() if max(pushed[n].status for n in nodes) > Status.EXACT}
    ids = tree = None
    if loose and mode != "pushdown":
        traced = without_limits(pipeline, pushed)
        pruning = pushed if traced is pipeline else push_down(traced, f)
        tree = join_tree(traced, pruning)
    if loose and mode != "pushdown" and not tree:
        filters = {s: _both(pushed[s], pruning[s]) for s in pipeline.sources}
        tracked, refs = traced.referred(reduced(traced.identified(filters), outwards(traced, filters)))
        ids = refs.resolved(tracked.filter(f.to_column()), sorted(loose))
        if len(loose) > 1:  # read once for each table, so run once
            ids = stored(ids.distinct(), "lineage")
    out = {}
    for table, nodes in by_table.items():
        predicate = simplify(any_of([p for n in nodes if not (isinstance(p := pushed[n].predicate, Lit) and p.value is False)])) if nodes else FALSE
        status, reasons = max(pushed[n].status for n in nodes), [r for n in nodes for r in pushed[n].reasons]
        if table in loose and tree:
            out[table] = SourceLineage(table, predicate, status, reasons, tree.rows({s: s.frame(pipeline.spark) for s in pipeline.sources}, nodes[0]), True)
        elif table in loose and ids is not None:
            own = nodes[0].identified(pipeline.spark).filter(predicate.to_column())
            mine = ids.filter(F.col("source") == table).select(F.col("rid").alias(RID))
            # Which side is broadcast is left to the optimizer: a predicate's lineage may be large.
            out[table] = SourceLineage(table, predicate, status, reasons, own.join(mine, RID, "left_semi").drop(RID), True)
        else:
            out[table] = SourceLineage(table, predicate, status, reasons, nodes[0].frame(pipeline.spark).filter(predicate.to_column()), status == Status.EXACT)
    return Lineage(out)


def _both(one: Pushed, other: Pushed) -> Expr:
    """What may prune a source by either of two passes over the same question."""
    return simplify(And(one.prune, other.prune))


def eager_lineage(pipeline: Pipeline, f: Expr, tables: Collection[str] | None = None) -> Lineage:
    """By tracking row identities through every operator: the baseline, and the measure of the other ways."""
    tracked, refs = pipeline.referred()
    ids = refs.resolved(tracked.filter(f.to_column()), sorted({s.table for s in pipeline.sources if tables is None or s.table in tables}))
    out = {}
    for s in pipeline.sources:
        if s.table not in out and (tables is None or s.table in tables):
            mine = ids.filter(F.col("source") == s.table).select(F.col("rid").alias(RID))
            out[s.table] = SourceLineage(s.table, FALSE, Status.EXACT, [], s.identified(pipeline.spark).join(mine, RID, "left_semi").drop(RID), True)
    return Lineage(out)
