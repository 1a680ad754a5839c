"""Comparing a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
