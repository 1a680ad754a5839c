"""The operators of a pipeline."""

from .aggregates import AllAggregate, CumAggr, DropDuplicate, GroupBy, GroupingSets, agg
from .base import LINEAGE, Node, Push, Status
from .joins import AntiJoin, Append, Combine, ConcatColumn, CrossJoin, InnerJoin, Join, LeftOuterJoin, NotIn, SemiJoin
from .nested import CogroupedMap, CrosstableUDF, GroupedMap, PipelinePath, ScalarComputation, SetItemWithDependency, SubPipeline, Subquery, SubpipeInput, outer
from .ranges import AsOfJoin, IntervalJoin
from .reshape import Pivot, SortValues, TopN, UnPivot
from .rowwise import ChangeType, Copy, DropColumns, DropNA, FillNA, Filter, GetDummies, Rename, Select, SetItem, Split

__all__ = [
    "AllAggregate", "AntiJoin", "Append", "AsOfJoin", "ChangeType", "CogroupedMap", "Combine", "ConcatColumn", "Copy", "CrossJoin", "CrosstableUDF", "CumAggr", "DropColumns", "DropDuplicate", "DropNA", "FillNA", "Filter",
    "GetDummies", "GroupBy", "GroupedMap", "GroupingSets", "InnerJoin", "IntervalJoin", "Join", "LINEAGE", "LeftOuterJoin", "Node", "NotIn", "PipelinePath", "Pivot", "Push", "Rename", "ScalarComputation", "Select", "SemiJoin",
    "SetItem", "SetItemWithDependency", "SortValues", "Split", "Status", "SubPipeline", "Subquery", "SubpipeInput", "TopN", "UnPivot", "agg", "outer",
]
