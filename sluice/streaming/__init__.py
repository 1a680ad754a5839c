"""Running the row-wise part of a pipeline on streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..operators.base import Node
from ..operators.nested import SubpipeInput
from ..operators.joins import Append
from ..operators.rowwise import RowWise
from ..pipeline import Pipeline
from ..sources.tables import Source


def follow(pipeline: Pipeline, streams: Mapping[str, DataFrame]) -> DataFrame:
    """The result as a stream, the sources' tables replaced by streams of the same columns.

    Operators that keep rows apart run on a stream as they do on a table; others need a
    watermark and an output mode, which a pipeline doesn't state, and are refused.
    """
    made: dict[Node, DataFrame] = {}
    for n in pipeline.nodes:
        if isinstance(n, Source):
            made[n] = streams[n.table]
        elif isinstance(n, (RowWise, Append, SubpipeInput)):
            made[n] = n.build(*[made[i] for i in n.inputs])
        else:
            raise TypeError(f"{n!r} can't follow a stream")
    return made[pipeline.sink]
