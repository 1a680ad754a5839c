"""Packing along a space-filling curve.

Each document's hashed word vector is projected to a few dimensions, the cell it
falls in gets its Hilbert key, the documents are range-sorted by that key and cut
into sequences as they come, so that neighbours along the curve share sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_arrow, materialize, mix, partitions, text_slices
from .tokens import cached

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position along the Hilbert curve of each row of cells, integers below 2**bits in each of n columns.

    Walks from the coarsest bit down, keeping for each row the rotation of the
    sub-cube as an XOR flip and a swap of axes (Skilling's transposed form).
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def project(codes: np.ndarray, counts: np.ndarray, hashes: np.ndarray, dims: int, bits: int, buckets: int) -> np.ndarray:
    """Cells of texts: their hashed word-count vectors, of unit length, on `dims` random directions."""
    rows = np.repeat(np.arange(len(counts)), counts)
    bucket = (hashes[codes] % np.uint64(buckets)).astype(np.int64)
    at, n = np.unique(rows * buckets + bucket, return_counts=True)
    row, bucket = at // buckets, at % buckets
    norm = np.sqrt(np.bincount(row, n.astype(float) ** 2, len(counts)))
    cells = np.zeros((len(counts), dims), np.int64)
    for d in range(dims):
        sign = np.where(mix(bucket.astype(np.uint64), d + 1) & np.uint64(1), 1.0, -1.0)
        p = np.bincount(row, n * sign, len(counts)) / np.maximum(norm, 1)
        cells[:, d] = np.clip((2**bits) / (1 + np.exp(-1.6 * np.clip(p, -30, 30))), 0, 2**bits - 1)
    return cells


def tokenized(df: DataFrame, vocab: str, end_id: int, dims: int = 4, bits: int = 12, buckets: int = 4096) -> DataFrame:
    """doc_id, hilbert_key, n (ids with the end id), ids (zstd of little-endian unsigned 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cached(vocab, False)
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = as_bytes(batch.column("text"))
            for lo, texts in text_slices(text):
                codes, counts = words.words(texts)
                ids, lengths = words.gather(codes, counts)
                spread = mix(word_hashes(words, codes))
                key = hilbert_key(project(np.arange(len(codes)), counts, spread, dims, bits, buckets), bits)
                small = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
                ends = np.cumsum(lengths)
                tail = np.array([[end_id]], "<u4").view(np.uint8).reshape(1, 4)
                blobs = [press.compress(planes(np.concatenate([small[e - n : e], tail]))) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(lo, len(texts)), "hilbert_key": pa.array(key, pa.int64()), "n": pa.array(lengths + 1, pa.int64()), "ids": pa.array(blobs, pa.binary())})

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, "doc_id long, hilbert_key long, n long, ids binary")


def word_hashes(words, codes: np.ndarray) -> np.ndarray:
    """A hash of each word that doesn't depend on the order in which the cache saw it: of its ids."""
    starts, lengths = words.starts[codes], words.lengths[codes]
    first = words.flat[np.minimum(starts, len(words.flat) - 1)].astype(np.uint64)
    last = words.flat[np.clip(starts + lengths - 1, 0, len(words.flat) - 1)].astype(np.uint64)
    mid = words.flat[np.clip(starts + lengths // 2, 0, len(words.flat) - 1)].astype(np.uint64)
    return first | last << np.uint64(20) | mid << np.uint64(40)


def planes(rows: np.ndarray) -> bytes:
    """Bytes of 32-bit ids by significance: the zero planes then cost nothing."""
    return np.ascontiguousarray(rows.T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Cutter:
    """Fills sequences of `size` ids in the order of the documents; gives rows of PIECES.

    What is left at the end is cut into powers of two, which need no padding.
    """

    def __init__(self, size: int, first_id: int):
        self.size, self.sequence, self.filled, self.waiting, self.rows = size, first_id, 0, [], []

    def add(self, doc_id: int | None, key: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.size - self.filled, len(ids) - at)
            self.waiting.append((doc_id, key, at, ids[at : at + n], len(ids)))
            at += n
            self.filled += n
            if self.filled == self.size:
                self._close(self.waiting)
                self.waiting, self.filled = [], 0

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, key, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset, key))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        left, room, open_ = self.filled, 0, []
        queue = self.waiting[::-1]
        while left:
            room = room or 1 << (left.bit_length() - 1)
            doc_id, key, start, ids, total = queue.pop()
            n = min(room, len(ids))
            open_.append((doc_id, key, start, ids[:n], total))
            if n < len(ids):
                queue.append((doc_id, key, start + n, ids[n:], total))
            room, left = room - n, left - n
            if not room:
                self._close(open_)
                open_ = []
        self.waiting, self.filled = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(df: DataFrame, vocab: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs every document of df (doc_id, text) into sequences of `size` ids; one row for each piece.

    A document is its ids followed by `end_id`; a null or empty text is the end id
    alone. Sequences hold neighbours along the curve, filled end to end; the last of
    each partition is cut into powers of two, so no sequence needs padding. Equal
    texts follow one another, ordered by doc_id (null first); repeated rows are
    packed once for each row. A text of any length is cut over as many sequences as
    it needs. An empty table gives no rows. Other columns are ignored, whatever
    their names. sequence_id is unique, not consecutive.

    Tokenisation is written to the shared folder once (about the size of the input);
    the range sort samples and shuffles that table, not the texts.
    """
    spark = df.sparkSession
    ids = materialize(tokenized(df, vocab, end_id), "packing")
    by_curve = ids.repartitionByRange(partitions(spark), "hilbert_key", F.hash("doc_id")).sortWithinPartitions("hilbert_key", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(size, (TaskContext.get().partitionId() + 1) << 40)
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, key, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hilbert_key", "ids")), strict=True):
                cut.add(doc_id, key, unplanes(press.decompress(blob)))
                if len(cut.rows) >= 20_000:
                    yield cut.take()
            yield cut.take()
        cut.finish()
        yield cut.take()

    return by_curve.transform(in_arrow, run, PIECES)
