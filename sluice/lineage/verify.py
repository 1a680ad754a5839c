"""Checks on the data: pruning changes nothing, two answers agree."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..pipeline import Pipeline
from ..predicate import Expr
from .pushdown import push_down


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same rows, each as often."""
    b = b.select(*[f"`{c}`" for c in a.columns])
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def verify_pruning(pipeline: Pipeline, f: Expr) -> bool:
    """Filtering the result by f gives what filtering the sources first, then the result, gives."""
    pushed = push_down(pipeline, f)
    pruned = pipeline.pruned({s: pushed[s].prune for s in pipeline.sources})
    return same_rows(pipeline.frame().filter(f.to_column()), pruned.filter(f.to_column()))
