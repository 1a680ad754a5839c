"""All queries of the pipeline and lineage engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import Node
from ..pipeline import Pipeline
from ..sources import ParquetTable
from . import lineage_queries, operator_queries, tpch

#: Unique keys of the tables; line items have none, so they are known by their place.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"],
}


def tables(sf_dir: str) -> Callable[[str], Node]:
    def table(name: str) -> Node:
        return ParquetTable(f"{sf_dir}/{name}.parquet", name, KEYS.get(name))

    return table


def pipeline_query(make: Callable[[Callable[[str], Node]], Node]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Pipeline(spark, make(tables(sf_dir))).frame()

    return run


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items that the first row of the top orders was made from."""
    return lineage_queries.QUERIES["lineage_q3_lineitem"](spark, sf_dir)


def queries() -> dict:
    found = {f"tpch_{n}": pipeline_query(make) for n, make in tpch.PIPELINES.items()}
    return found | {f"operator_{n}": pipeline_query(make) for n, make in operator_queries.PIPELINES.items()} | lineage_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {f"tpch_{n}": sql for n, sql in tpch.SQL.items()} | {f"operator_{n}": sql for n, sql in operator_queries.SQL.items()} | lineage_queries.SQL
