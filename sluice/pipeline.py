"""A pipeline: a graph of operators that ends in one, compiled to one DataFrame for each node."""

from __future__ import annotations

from collections.abc import Mapping
from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.base import LINEAGE, RID, Node, References, data_columns
from .predicate import Expr
from .sources.tables import Source


class Pipeline:
    """The operators below `sink`, in an order in which inputs come first."""

    def __init__(self, spark: SparkSession, sink: Node):
        self.spark, self.sink = spark, sink
        self.nodes: list[Node] = []
        self._visit(sink, set())
        self._frames: dict[Node, DataFrame] = {}
        self._columns: dict[Node, list[str]] = {}
        self._types: dict[Node, dict[str, str]] = {}

    def _visit(self, node: Node, seen: set[int]) -> None:
        if id(node) in seen:
            return
        seen.add(id(node))
        for i in node.inputs:
            self._visit(i, seen)
        self.nodes.append(node)

    @property
    def sources(self) -> list[Source]:
        return [n for n in self.nodes if isinstance(n, Source)]

    def frame(self, node: Node | None = None) -> DataFrame:
        """What a node, by default the last, gives. Lazy, and made once for each node."""
        node = node or self.sink
        if node not in self._frames:
            self._frames[node] = node.frame(self.spark) if isinstance(node, Source) else node.build(*[self.frame(i) for i in node.inputs])
        return self._frames[node]

    def columns(self, node: Node) -> list[str]:
        if node not in self._columns:
            self._columns[node] = data_columns(self.frame(node))
        return self._columns[node]

    def types(self, node: Node) -> dict[str, str]:
        """The type of each of a node's columns, as Spark writes it."""
        if node not in self._types:
            self._types[node] = {f.name: f.dataType.simpleString() for f in self.frame(node).schema}
        return self._types[node]

    def pruned(self, filters: Mapping[Node, Expr]) -> DataFrame:
        """The result over sources that are filtered first."""
        made: dict[Node, DataFrame] = {}
        for n in self.nodes:
            if isinstance(n, Source):
                df = n.frame(self.spark)
                made[n] = df.filter(filters[n].to_column()) if n in filters else df
            else:
                made[n] = n.build(*[made[i] for i in n.inputs])
        return made[self.sink]

    def identified(self, filters: Mapping[Node, Expr] | None = None) -> dict[Node, DataFrame]:
        """The sources with RID, filtered."""
        out = {s: s.identified(self.spark) for s in self.sources}
        return {s: df.filter(filters[s].to_column()) if filters and s in filters else df for s, df in out.items()}

    def tracked(self, frames: Mapping[Node, DataFrame] | None = None, node: Node | None = None) -> DataFrame:
        """The result with LINEAGE: for each row, the source rows it was made from. frames: the sources with RID, without rows that don't matter."""
        made: dict[Node, DataFrame] = {}
        frames = frames or self.identified()
        for n in self.nodes:
            made[n] = _known(n, frames[n]) if isinstance(n, Source) else n.track(*[made[i] for i in n.inputs])
        return made[node or self.sink]

    def referred(self, frames: Mapping[Node, DataFrame] | None = None) -> tuple[DataFrame, References]:
        """As tracked, with references to the rows that a row gathers, and what resolves them."""
        made: dict[Node, DataFrame] = {}
        reach: dict[Node, set[str]] = {}
        frames, refs = frames or self.identified(), References()
        for n in self.nodes:
            if isinstance(n, Source):
                made[n], reach[n] = _known(n, frames[n]), {n.table}
                continue
            before, inside = len(refs.groups), set().union(*[reach[i] for i in n.inputs])
            made[n] = n.refer(refs, *[made[i] for i in n.inputs])
            for g in refs.groups[before:]:
                g.reach = inside
            reach[n] = inside | {g.source for g in refs.groups[before:]}
        return made[self.sink], refs

    def reading(self, stored: Mapping[Node, Source]) -> Pipeline:
        """The same pipeline with some nodes replaced by sources that hold their results."""
        return self.replacing(stored)

    def replacing(self, others: Mapping[Node, Node]) -> Pipeline:
        """The same pipeline with some nodes replaced by others, whose columns are the same and whose inputs, if any, are nodes of this one."""
        made: dict[Node, Node] = {}
        for n in self.nodes:
            made[n] = others.get(n, n)
            if made[n].inputs:
                made[n] = copy(made[n])
                made[n].inputs = tuple(made[i] for i in made[n].inputs)
        out = Pipeline(self.spark, made[self.sink])
        out._columns = {made[n]: columns for n, columns in self._columns.items()}
        out._types = {made[n]: types for n, types in self._types.items()}
        return out

    def unique_keys(self) -> dict[Node, set[frozenset[str]]]:
        """Unique keys of every node, from those that sources declare."""
        out: dict[Node, set[frozenset[str]]] = {}
        for n in self.nodes:
            out[n] = n.keys([out[i] for i in n.inputs], [self.columns(i) for i in n.inputs])
        return out


def _known(source: Source, df: DataFrame) -> DataFrame:
    """A source's rows with their own identity as LINEAGE."""
    return df.withColumn(LINEAGE, F.array(F.struct(F.lit(source.table).alias("source"), F.col(RID).alias("rid")))).drop(RID)
