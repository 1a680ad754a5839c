"""Fresh folders where driver and executors share files."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share every folder."""
    return spark.sparkContext.master.split("[")[0] == "local"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder of this machine where that is unset and Spark runs in one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = where or f"file://{tempfile.gettempdir()}/checkpoints/sluice-{os.getuid()}"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to a fresh folder and read back; the folder goes when this process ends, if Spark still runs."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, name)
    df.write.parquet(path)

    def remove() -> None:
        context = spark.sparkContext
        if context._jsc is not None:
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)
