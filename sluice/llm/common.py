"""What the operators share: the folder all executors see, materialised tables, text batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, what separates words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own where that is unset and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/sluice-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; through Spark, or, once it has stopped, if the path is a local one."""
    context = spark.sparkContext
    if context._jsc is not None:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
    elif path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: later stages restart from the files, whichever executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """The number of words, runs of other than ASCII white space; null has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WORD_GAP))).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of doc_id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def least_hash(share: float) -> int:
    """The 64-bit hash below which the given share of all hashes lies; exact for shares far below one in 2**20."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def sampled(share: float, *columns: str) -> Column:
    """Whether a row is in a sample of the given share, by a 64-bit hash of the columns."""
    return F.lit(True) if share >= 1 else F.xxhash64(*columns) < F.lit(least_hash(share))


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column of a batch as UTF-8 bytes, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.view(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.binary())


def text_slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """(first row, texts as bytes or None) for runs of rows of about `most` bytes; a longer text comes alone."""
    lo, total, out = 0, 0, []
    for i, x in enumerate(column):
        x = x.as_py()
        if out and total + len(x or b"") > most:
            yield lo, out
            lo, total, out = i, 0, []
        out.append(x)
        total += len(x or b"")
    if out:
        yield lo, out


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker hands memory that it no longer needs back to the system at the end of a task.

    Workers are kept for other tasks, and those of one executor share its memory with it.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow of run, in batches of some MB.

    Batches are counted in rows otherwise, and texts may be long. The setting is the
    session's, as plans run later; one that is already there is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df.mapInArrow(frugal(run), schema)


class Codes(dict):
    """Numbers words in order of appearance; forgets all once it holds `most`."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def full(self) -> bool:
        return len(self) > self.most


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Slots of one row of Spark's bitmap functions.
BITMAP = 32_768
#: A filter of up to so many bytes is broadcast.
BROADCAST_BYTES = 64 << 20


def bitmap_bit(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap made by bitmap_construct_agg is set; false without a bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    power = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8).cast("int") + 1)
    return F.coalesce(byte.bitwiseAND(power) > 0, F.lit(False))


def split_by_filter(df: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash in column may be among the keys, rows whose is not): a Bloom filter of one hash.

    Rows of the second kind need no join. The filter has 16 slots a key up to
    BROADCAST_BYTES; with more keys it keeps that size and lets more rows through.
    """
    most = max(15, (8 * BROADCAST_BYTES).bit_length() - 1)
    bits = min(most, max(15, (16 * max(1, keys.count()) - 1).bit_length()))
    mask = (1 << bits) - 1
    slot = F.col(key).bitwiseAND(F.lit(mask))
    filled = keys.select(slot.alias("slot")).select(F.expr(f"slot div {BITMAP}").alias("__bucket"), F.expr(f"slot % {BITMAP}").alias("bit"))
    filled = materialize(filled.groupBy("__bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("__bitmap")), "filter")
    own = F.col(column).bitwiseAND(F.lit(mask))
    # 2**bits slots, so BROADCAST_BYTES at most
    tested = df.join(F.broadcast(filled), F.floor(own / BITMAP) == F.col("__bucket"), "left").withColumn("__may", bitmap_bit(F.col("__bitmap"), own % BITMAP)).drop("__bucket", "__bitmap")
    return tested.filter("__may").drop("__may"), tested.filter(~F.col("__may")).drop("__may")
