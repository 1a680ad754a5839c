"""Sources: tables whose rows have an identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import RID, Node, Push, name
from ..predicate import TRUE, Expr, all_of, simplify


class Source(Node):
    """A named table. key: columns that identify a row; without it the source must know its rows by place.

    Two nodes of one name are one table read twice: their lineages are merged.
    """

    def __init__(self, table: str, key: Sequence[str] | None = None):
        super().__init__()
        self.table, self.key = table, list(key) if key else None
        self.holds: Expr = TRUE

    def declared(self, *holds: Expr) -> Source:
        """This table, of all whose rows the predicates are true: a domain, a range, no nulls. Lineage relies on it; lineage.violations counts the rows that break it."""
        self.holds = simplify(all_of([self.holds, *holds]))
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows, without identities."""
        return self.read(spark)

    def identified(self, spark: SparkSession) -> DataFrame:
        """The rows with RID, a string that is the same on every read."""
        if not self.key:
            raise ValueError(f"{self.table}: rows can only be told apart by a declared key")
        return self.read(spark).withColumn(RID, F.to_json(F.struct(*[name(c) for c in self.key]), {"ignoreNullFields": "false"}))

    def build(self):
        raise TypeError("a source is read, not built")

    def push(self, f, columns, out):
        return []

    def keys(self, keys, columns):
        return {frozenset(self.key)} if self.key else set()

    def updated(self):
        return frozenset()

    def __repr__(self):
        return f"{type(self).__name__}({self.table})"


class ParquetTable(Source):
    """Parquet files; a row is known by its file and its place in it unless a key is given."""

    def __init__(self, path: str, table: str, key: Sequence[str] | None = None, columns: Sequence[str] | None = None):
        super().__init__(table, key)
        self.path, self.columns = path, columns

    def read(self, spark):
        df = spark.read.parquet(self.path)
        return df.select(*[name(c) for c in self.columns]) if self.columns else df

    def identified(self, spark):
        # Taken at the scan: the place of a row is lost after any operator.
        df = spark.read.parquet(self.path)
        own = [name(c) for c in (self.columns or df.columns)]
        return df.select(*own, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias(RID))


class CsvTable(Source):
    """CSV with a header; spaces after a separator are dropped. A CSV row has no place, so lineage needs a key."""

    def __init__(self, path: str, table: str, schema: str | None = None, key: Sequence[str] | None = None, **options):
        super().__init__(table, key)
        self.path, self.schema, self.options = path, schema, options

    def read(self, spark):
        reader = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, **self.options)
        return (reader.schema(self.schema) if self.schema else reader.option("inferSchema", True)).csv(self.path)


class FrameTable(Source):
    """A DataFrame that is at hand."""

    def __init__(self, df: DataFrame, table: str, key: Sequence[str] | None = None):
        super().__init__(table, key)
        self.df = df

    def read(self, spark):
        return self.df


class SqlTable(Source):
    """The rows of a SQL query over views of the session."""

    def __init__(self, text: str, table: str, key: Sequence[str] | None = None):
        super().__init__(table, key)
        self.text = text

    def read(self, spark):
        return spark.sql(self.text)


class JdbcTable(Source):
    """A table or query of a database, read over JDBC; its driver has to be on Spark's class path.

    options: url, dbtable or query, and partitionColumn with its bounds for reading in parallel.
    """

    def __init__(self, table: str, key: Sequence[str] | None = None, **options: str):
        super().__init__(table, key)
        self.options = options

    def read(self, spark):
        return spark.read.format("jdbc").options(**self.options).load()


def write_parquet(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The snapshot sink: df, or some of its columns, as Parquet; gives what was written."""
    out = df.select(*[name(c) for c in columns]) if columns else df
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


__all__ = ["CsvTable", "FrameTable", "JdbcTable", "ParquetTable", "Push", "RID", "Source", "SqlTable", "write_parquet"]
