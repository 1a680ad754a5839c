"""Reading tables with row identities, and sending this package to executors."""

from .tables import CsvTable, FrameTable, JdbcTable, ParquetTable, Source, SqlTable, write_parquet

__all__ = ["CsvTable", "FrameTable", "JdbcTable", "ParquetTable", "Source", "SqlTable", "write_parquet"]
