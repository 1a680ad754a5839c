"""Token counts of documents in flat token files, by a separator scan.

A flat file is nothing but little-endian token ids; documents end with one id and no
index says where. The files are cut into blocks, each block is searched for that id
at once, and a prefix scan over the blocks' summaries tells each block how many
documents ended before it and where the last one did, which stitches the documents
that cross block borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, in_arrow, materialize, partitions, scratch_path, text_slices
from .tokens import cached


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the files of a folder that Spark can list."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def write_token_files(df: DataFrame, folder: str, vocab: str, end_id: int, dtype: str = "<u2", file_bytes: int = 64 << 20) -> DataFrame:
    """Flat token files of df's texts in folder; gives (file, bytes, ordinal, doc_id), one row for each document.

    Each document is its ids and end_id; a null or empty text is end_id alone, and
    special tokens' strings in a text are ordinary text, so end_id never occurs inside
    one. An id that dtype can't hold is an error. A task that is run again writes files of new names; only those that the
    returned table names are whole, and it is written once, after them. The folder must
    be on a store that Arrow opens.
    """
    if not 0 <= end_id <= np.iinfo(dtype).max:
        raise ValueError(f"separator {end_id} doesn't fit in {dtype}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (fs, path) = cached(vocab, True), pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, out, rows, size = "", None, [], 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(rows)), pa.array([size] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.int64())], ["file", "bytes", "ordinal", "doc_id"])

        for batch in batches:
            for lo, texts in text_slices(as_bytes(batch.column("text"))):
                if out is None:
                    name, rows, size = f"{uuid.uuid4().hex}.bin", [], 0
                    out = fs.open_output_stream(f"{path}/{name}")
                codes, counts = words.words(texts)
                ids, lengths = words.gather(codes, counts)
                if len(ids) and ids.max() > np.iinfo(dtype).max:
                    raise ValueError(f"token id {ids.max()} doesn't fit in {dtype}")
                data = np.insert(ids, np.cumsum(lengths), end_id).astype(dtype).tobytes()
                out.write(data)
                size += len(data)
                rows += batch.column("doc_id").slice(lo, len(texts)).to_pylist()
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.transform(in_arrow, run, "file string, bytes long, ordinal long, doc_id long"), "manifest")


def separators(files: DataFrame, end_id: int, dtype: str, block_bytes: int) -> DataFrame:
    """(file, block, tokens, ends): of each block its number of tokens and the places of end_id in the file."""
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    blocks = files.filter(F.col("bytes") >= width).select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - width, F.lit(step).cast("long"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "at")), strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    data = f.read(min(step, (size - at) // width * width))
                ends = np.flatnonzero(np.frombuffer(data, dtype) == end_id) + at // width
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at // step], pa.int64()), pa.array([len(data) // width], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"])

    dealt = blocks.repartition(partitions(files.sparkSession), "file", "at")
    return materialize(dealt.transform(in_arrow, run, "file string, block long, tokens long, ends array<long>"), "separators")


def count_tokens(files: DataFrame, end_id: int, dtype: str = "<u2", block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each document of flat token files (file, bytes): file, ordinal, start, n_tokens, ended.

    ordinal counts a file's documents from 0, start is the place of the first token,
    n_tokens leaves out the separator. Two separators in a row hold a document of 0
    tokens. Tokens after the last separator are a document that has not ended; a byte
    left over at the end of a file is no token. An empty file, or no file, gives no
    rows; files named twice are read once; a null name or size is left out. Other
    columns are ignored.

    Blocks are read where tasks run, and only their summaries, a few numbers for every
    block_bytes, are scanned by file.
    """
    files = files.select("file", F.col("bytes").cast("long").alias("bytes")).dropna().dropDuplicates(["file"])
    found = separators(files, end_id, dtype, block_bytes)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    summary = found.select("file", "block", "tokens", F.size("ends").alias("n"), F.array_max("ends").alias("last_end"))
    summary = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended_before"), F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("last_before"),
                             F.sum("tokens").over(order).alias("reached"), F.coalesce(F.max("last_end").over(order), F.lit(-1)).alias("last_here"), F.sum("n").over(order).alias("ended_here"), last.alias("is_last"))
    summary = materialize(summary, "scan")
    starts = F.transform(F.concat(F.array("last_before"), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0)))), lambda x: x + 1)
    whole = found.join(summary, ["file", "block"]).filter(F.size("ends") > 0).select("file", "ended_before", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("k", "d"))
    whole = whole.select("file", (F.col("ended_before") + F.col("k")).cast("long").alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = summary.filter(F.col("is_last") & (F.col("reached") > F.col("last_here") + 1)).select("file", F.col("ended_here").cast("long").alias("ordinal"), (F.col("last_here") + 1).alias("start"), (F.col("reached") - F.col("last_here") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(tail)


def document_tokens(df: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens) of every row of df, counted from flat token files written for it.

    The files, two bytes a token, lie in the shared folder. Null and empty texts have 0
    tokens, repeated rows a row each, a null doc_id stays null.
    """
    manifest = write_token_files(df, scratch_path(df.sparkSession, "tokens"), vocab, end_id)
    counted = count_tokens(manifest.select("file", "bytes"), end_id)
    return manifest.select("file", "ordinal", "doc_id").join(counted.filter("ended"), ["file", "ordinal"]).select("doc_id", "n_tokens")
