"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Windows
of running text are compressed with the ordinary one alone and with both together;
by how many bytes the second way is shorter is the window's distance. A calibrated
logistic threshold turns the distribution of a text's distances into its score.

Toxic documents are ordinary for the most part, so the toxic dictionary is trained on
those of their windows that the ordinary dictionary compresses badly. Every window of
every text is measured both ways; of equal windows that are laid out together one is
compressed for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_of_id, in_arrow, materialize, partitions, sampled, text_slices

#: A window is so many bytes of folded text; the next one starts STEP bytes on, so a word of ten bytes lies whole in one.
WINDOW, STEP = 16, 6
#: What of a text is folded away: ASCII capitals are lowered, ASCII signs are spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Ends every window and every dictionary. It costs the same with either, keeps the window clear of the block's last
#: bytes, which the compressor doesn't search, and keeps the block compressible, so that none is stored as it is.
CARRIER = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Distances in bytes whose shares of a text's windows are its features.
STEPS = tuple(range(1, 10))
#: Bytes of the ordinary and of the toxic dictionary.
SIZES = (65_536, 4_096)
#: The quantile of the lengths of ordinary windows from which on a toxic document's window is trained on.
STRANGE = 0.9
#: Parts of the labelled sample that take turns in being left out of the dictionaries.
FOLDS = 3


def folded(text: bytes | None) -> bytes:
    """The text in lower case, its words between single spaces; empty if it has none."""
    words = text.translate(FOLD).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b""


#: A raw dictionary needs the trainer's segments alone, without the magic number and tables that a trained one begins with.
MAGIC = b"\x37\xa4\x30\xec"
#: Less text than so many times a dictionary's size is no choice to train on: the text itself is the dictionary.
LEAST_TEXT = 8


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The content of a dictionary of segments of k bytes, picked by how often the samples hold their runs of d bytes."""
    samples = [x for x in samples if len(x) >= 8]
    if len(samples) < 5 or sum(map(len, samples)) < LEAST_TEXT * size:
        return b"".join(samples)[-size:]
    made = zstandard.train_dictionary(size, samples, k=k, d=d, level=3)
    return content_of(made.as_bytes())


def content_of(dictionary: bytes) -> bytes:
    """A trained dictionary without its header: what follows the entropy tables, whose last part are the three repeat offsets 1, 4 and 8."""
    if dictionary[:4] != MAGIC:
        return dictionary
    offsets = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))
    return dictionary[dictionary.index(offsets, 8) + len(offsets) :]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Raw content, so that literals cost whole bytes however short the window is."""
    d = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(
        5, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


#: Windows that are laid out and compressed at once.
AT_ONCE = 50_000
#: Windows among which equal ones are looked for, and bytes of the texts that are scored together: bounds of a task's memory.
AMONG, TOGETHER = 2_000_000, 12_000_000
#: Odd factors that spread the bits of a window's bytes, eight at a time, over its hash.
SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def places(text: bytes) -> range:
    """Where the windows of a folded text start; together they hold all of it, a short text is one."""
    return range(0, max(1, len(text) - WINDOW + STEP), STEP) if text else range(0)


def distinct(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each lot of equal windows, in order; for each window the place there of the one that it equals).

    Neighbours by hash are compared whole, so a collision may keep a window twice, but never takes it for another.
    """
    words = np.ndarray(len(text) + WINDOW, np.uint64, np.concatenate([text, np.zeros(WINDOW + 8, np.uint8)]), strides=(1,))
    # What follows a short window in the text is compared with it, which keeps one more at worst.
    keys = [words[starts + i] for i in range(0, WINDOW, 8)]
    mixed = np.bitwise_xor.reduce([k * m for k, m in zip(keys, SPREAD, strict=True)])
    order = np.argsort(mixed ^ mixed >> np.uint64(32))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (*keys, sizes):
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    lots = np.flatnonzero(new)
    first = np.minimum.reduceat(order, lots) if len(lots) else order
    kept = np.zeros(len(order), bool)
    kept[first] = True
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat((np.cumsum(kept) - 1)[first], np.diff(lots, append=len(order)))
    return np.flatnonzero(kept), of


def lengths(compressors: list[zstandard.ZstdCompressor], text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """By compressor, the compressed length of each window, given as its place in text and its size, with CARRIER behind it.

    Of equal windows, which have equal lengths, one is compressed.
    """
    out = [[np.zeros(0, np.int64)] for _ in compressors]
    for lo in range(0, len(starts), AMONG):
        at, size = starts[lo : lo + AMONG], sizes[lo : lo + AMONG]
        base = int(at[0])
        part = text[base : int(at[-1]) + WINDOW]
        which, of = distinct(part, at - base, size)
        for own, x in zip(out, compressed(compressors, part, at[which] - base, size[which]), strict=True):
            own.append(x[of])
    return [np.concatenate(x) for x in out]


def compressed(compressors: list[zstandard.ZstdCompressor], text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """lengths, where every window given is compressed."""
    out, carrier = [[np.zeros(0, np.int64)] for _ in compressors], np.frombuffer(CARRIER, np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(WINDOW, np.uint8)]), WINDOW)
    for lo in range(0, len(starts), AT_ONCE):
        at, size = starts[lo : lo + AT_ONCE], sizes[lo : lo + AT_ONCE]
        rows = np.empty((len(at), WINDOW + len(carrier)), np.uint8)
        rows[:, :WINDOW] = cut[at]
        rows[:, WINDOW:] = carrier
        for i in np.flatnonzero(size < WINDOW):
            rows[i, size[i] : size[i] + len(carrier)] = carrier
        segments = np.stack([np.arange(len(at)) * rows.shape[1], size + len(carrier)], axis=1).astype(np.uint64)
        windows = zstandard.BufferWithSegments(rows.tobytes(), segments.tobytes())
        for c, own in zip(compressors, out, strict=True):
            own.append(np.fromiter(map(len, c.multi_compress_to_buffer(windows, threads=1)), np.int64, len(at)))
    return [np.concatenate(x) for x in out]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the folded texts end to end, place and size of each window, number of windows of each text)."""
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    own = [places(x) for x in texts]
    counts = np.array([len(x) for x in own], np.int64)
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(x.start, x.stop, STEP) + (e - len(t)) for x, e, t in zip(own, ends, texts, strict=True)]])
    return np.frombuffer(b"".join(texts), np.uint8), starts, np.minimum(WINDOW, np.repeat(ends, counts) - starts), counts


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about TOGETHER bytes, as more windows are equal among more texts."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= TOGETHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    @classmethod
    def train(cls, ordinary: list[bytes], toxic: list[bytes]) -> Dictionaries:
        """From folded texts of either label."""
        base = trained([x[i : i + 64] for x in ordinary for i in range(0, len(x), 64)], SIZES[0], 16, 6)
        c = compressor(base)
        (usual,) = lengths([c], *laid_out(ordinary)[:3])
        strange = np.quantile(usual, STRANGE) if len(usual) else 0
        text, starts, sizes, _ = laid_out(toxic)
        whole, odd = text.tobytes(), lengths([c], text, starts, sizes)[0] >= strange
        own = [whole[i : i + n] for i, n in zip(*(x[odd].tolist() for x in (starts, sizes)), strict=True)]
        return cls(base, trained(own, SIZES[1], 12, 8))


class Distances:
    """By how many bytes windows get shorter where the toxic dictionary is at hand beside the ordinary one."""

    def __init__(self, d: Dictionaries):
        self.ordinary, self.both = compressor(d.ordinary), compressor(d.ordinary + d.toxic)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the distances of all windows of folded texts, the number for each text)."""
        text, starts, sizes, counts = laid_out(texts)
        ordinary, both = lengths([self.ordinary, self.both], text, starts, sizes)
        return ordinary - both, counts

    def features(self, texts: list) -> np.ndarray:
        """A row for each text: roots of the shares of windows at each of STEPS, mean of the top three, mean, log of the number."""
        out, (distances, n) = np.zeros((len(texts), len(STEPS) + 3)), self.of([folded(x) for x in texts])
        if not len(distances):
            return out
        least, has = min(0, int(distances.min())), n > 0
        values = np.arange(least, max(STEPS[-1], int(distances.max())) + 1)
        # How many windows of each text have which distance: all features come from that.
        counts = np.bincount(np.repeat(np.arange(len(n)), n) * len(values) + (distances - least), minlength=len(n) * len(values)).reshape(len(n), -1)[has]
        at_least, n = counts[:, ::-1].cumsum(axis=1)[:, ::-1], n[has]
        out[has, : len(STEPS)] = np.sqrt(at_least[:, np.array(STEPS) - least] / n[:, None])
        k = np.minimum(n, 3)
        top = np.diff(np.minimum(at_least, k[:, None]), axis=1, append=0) @ -values / k
        out[has, len(STEPS) :] = np.stack([top, counts @ values / n, np.log(n)], axis=1)
        return out


@dataclass
class Model:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, shift: float, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features and the weights, by Newton's method with a small ridge. shift: log of how much more often label 1 was sampled."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (p - y) + w)
    w[-1] -= shift
    return mean, scale, w


def fit(df: DataFrame, labels: DataFrame, most: tuple[int, int] = (6_000, 4_000), held_out=None) -> Model | None:
    """The dictionaries and the calibration, from about `most` labelled documents of label 0 and of label 1; None if a label has none.

    held_out: a function of a doc_id column; rows for which it is true are not learned
    from. The calibration is cross-fitted: each of FOLDS parts of the sample is measured
    with dictionaries that were trained without it. A document with both labels counts
    as toxic.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter("toxic IN (0, 1)")
    if held_out is not None:
        marked = marked.filter(~held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    have = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(have) < 2:
        return None
    share = [min(1.0, most[c] / have[c]) for c in (0, 1)]
    few = marked.filter(F.when(F.col("toxic") == 1, sampled(share[1], "id")).otherwise(sampled(share[0], "id")))
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    # Bounded by `most`, so it is broadcast.
    rows = df.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("id"))
    # One text for each id, however often it is repeated: the least, so that the sample keeps its bound.
    rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", fold)
    rows = materialize(rows, "labelled")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for x, label, without in zip(as_bytes(batch.column("text")).to_pylist(), batch.column("toxic").to_pylist(), batch.column("without").to_pylist(), strict=True):
                texts.setdefault(without, ([], []))[label].append(folded(x))
        for without, (ordinary, toxic) in texts.items():
            d = Dictionaries.train(sorted(ordinary), sorted(toxic))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((without, pa.int32()), (d.ordinary, pa.binary()), (d.toxic, pa.binary()))], ["without", "ordinary", "toxic"])

    # FOLDS + 1 trainings, each on the sample of `most` documents at most, in a task.
    apart = rows.withColumn("without", F.explode(F.array(*[F.lit(f) for f in range(FOLDS + 1)]))).filter("fold <> without").select("text", "toxic", "without")
    made = apart.repartitionByRange(FOLDS + 1, "without").transform(in_arrow, train, "without int, ordinary binary, toxic binary").collect()
    pairs = {r.without: Dictionaries(bytes(r.ordinary), bytes(r.toxic)) for r in made}
    if FOLDS not in pairs:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances: dict[int, Distances] = {}
        for batch in batches:
            folds = np.array(batch.column("fold").to_pylist())
            for lo, texts in text_slices(as_bytes(batch.column("text"))):
                of, x = folds[lo : lo + len(texts)], np.zeros((len(texts), len(STEPS) + 3))
                for f in np.unique(of):
                    if f not in distances:
                        distances[f] = Distances(pairs.get(int(f), pairs[FOLDS]))
                    x[of == f] = distances[f].features([t for t, g in zip(texts, of, strict=True) if g == f])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic").slice(lo, len(texts))], ["x", "toxic"])

    dealt = rows.repartition(partitions(df.sparkSession))
    seen = sorted(dealt.transform(in_arrow, features, "x array<double>, toxic int").collect())
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen])
    return Model(pairs[FOLDS], *logistic(x, y, float(np.log(share[1] / share[0]))))


def toxicity(df: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out=lambda doc_id: crc_of_id(doc_id) % 4 == 2, **parameters) -> DataFrame:
    """One row for each row of df (doc_id, text): doc_id, held_out, score, predicted.

    Only the text enters the score. Labels of rows held out are never learned from;
    labels with a null in doc_id or toxic are ignored, and without both labels every
    score is 0. A null or empty text has no windows and gets the score of such a text.
    Very long texts are scored over all their windows. Repeated rows score alike, a
    null doc_id stays null, other columns are ignored. An empty table gives no rows.
    One pass, no shuffle.
    """
    model = fit(df, labels, held_out=held_out, **parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.dictionaries) if model else None
        for batch in together(batches):
            for lo, texts in text_slices(as_bytes(batch.column("text")), TOGETHER):
                score = model.score(distances.features(texts)) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, len(texts)) for c in ("doc_id", "held_out")], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, held_out boolean, score double, predicted int")
