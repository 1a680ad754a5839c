"""Language by bit-sliced Bloom filters of character n-grams.

One filter serves all languages: each slot is a bitmask with a bit for each of them.
The masks of an n-gram's slots, ANDed, name every language that holds the n-gram. A
text's n-grams are counted by language, the counts are corrected for the filters'
false positives, and the highest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, crc_of_id, in_arrow, least_hash, materialize, mix, text_slices

GRAM = 4
UNKNOWN = "und"


def lettered(text: bytes | None) -> bool:
    """Whether a text holds a letter, that is a character of Unicode category L."""
    return bool(text) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def _folded() -> np.ndarray:
    """For each code point: its lower case if a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


FOLDED: list[np.ndarray] = []


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of letters and single spaces of all texts, number for each text)."""
    if not FOLDED:
        FOLDED.append(_folded())
    whole, sizes = [], np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        # A space and n - 1 more on either side, so that no n-gram spans two texts.
        u = np.frombuffer(((x or b"").decode("utf-8", "replace")).encode("utf-32-le", "replace"), np.uint32)
        whole.append(u)
        sizes[i] = len(u) + 2
    chars = np.full(int(sizes.sum()), 32, np.uint32)
    ends = np.cumsum(sizes)
    for u, e in zip(whole, ends, strict=True):
        chars[e - 1 - len(u) : e - 1] = u
    low = FOLDED[0][chars]
    of = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (of[1:] != of[:-1])
    low, of = low[keep].astype(np.uint64), of[keep]
    n = len(low) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = key * np.uint64(0x10FFFF + 1) + low[k : k + n] if k < 3 else mix(key) ^ low[k : k + n]
    inside = (of[:n] == of[GRAM - 1 :]) & ((low[1 : 1 + n] != 32) | (low[2 : 2 + n] != 32))
    return mix(key[inside], 1), np.bincount(of[:n][inside], minlength=len(texts))


@dataclass
class Filters:
    """slots: (2**bits, words of 64 languages); false: by language, the chance that a strange n-gram is found."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray
    hashes: int

    def positions(self, keys: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        step = keys >> np.uint64(32) | np.uint64(1)
        return [((keys + np.uint64(i) * step) & mask).astype(np.int64) for i in range(self.hashes)]

    @classmethod
    def build(cls, keys: dict[str, np.ndarray], hashes: int = 3, slots_a_key: int = 16) -> Filters:
        languages = sorted(keys)
        size = 1 << max(12, (slots_a_key * max((len(k) for k in keys.values()), default=1) - 1).bit_length())
        out = cls(languages, np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64), np.zeros(len(languages)), hashes)
        for i, name in enumerate(languages):
            bit = np.uint64(1 << (i % 64))
            for at in out.positions(keys[name]):
                out.slots[at, i // 64] |= bit
            out.false[i] = ((out.slots[:, i // 64] & bit) != 0).mean() ** hashes
        return out

    def counts(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By text and language: n-grams found, less those expected by chance, as a share of the text's n-grams."""
        found = None
        with np.errstate(over="ignore"):
            for at in self.positions(keys):
                found = self.slots[at] if found is None else found & self.slots[at]
        rows, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(sizes), len(self.languages)))
        for i in range(len(self.languages)):
            has = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            share = np.bincount(rows, has, len(sizes)) / np.maximum(sizes, 1)
            out[:, i] = np.maximum(0, (share - self.false[i]) / (1 - self.false[i]))
        return out


def fit(df: DataFrame, held_out, most: int = 20_000, least: float = 0.002, beside: float = 0.25) -> Filters | None:
    """Filters from about `most` labelled rows, in equal parts from the languages; None if no row has one.

    A language holds the n-grams found in 2 of its sampled documents or more, in the
    share `least` of them, and in no less than `beside` times the share that any other
    language has. As the shares add up to the distinct n-grams of an average document,
    there are that many over `least` at most, however large the corpus. Repeated rows
    are sampled alike.
    """
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    have = {r.lang: r["count"] for r in df.filter(usable).groupBy("lang").count().collect()}
    if not have:
        return None
    shares = {k: min(1.0, most / len(have) / n) for k, n in have.items()}
    bounds = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, least_hash(v))])
    few = df.filter(usable).filter(F.xxhash64("doc_id", "text") <= bounds[F.col("lang")]).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, texts in text_slices(as_bytes(batch.column("text"))):
                keys, sizes = grams(texts)
                of, mine = langs[lo : lo + len(texts)], [np.unique(k) for k in np.split(keys, np.cumsum(sizes)[:-1])]
                for name in set(of):
                    own = np.concatenate([k for k, x in zip(mine, of, strict=True) if x == name])
                    gram, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = few.transform(in_arrow, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sampled = {k: max(1.0, have[k] * v) for k, v in shares.items()}
    of = F.create_map(*[F.lit(x) for k, v in sampled.items() for x in (k, float(v))])
    rate = F.col("n") / of[F.col("lang")]
    top = F.max("rate").over(Window.partitionBy("gram"))
    kept = materialize(counted, "grams").withColumn("rate", rate).withColumn("top", top).filter((F.col("n") >= 2) & (F.col("rate") >= least) & (F.col("rate") >= beside * F.col("top")))
    found = kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # bounded by the sample, see above
    keys = {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in found}
    return Filters.build({k: keys.get(k, np.zeros(0, np.uint64)) for k in have})


def language(df: DataFrame, held_out=lambda doc_id: crc_of_id(doc_id) % 3 == 1, **parameters) -> DataFrame:
    """One row for each row of df (doc_id, text, lang): doc_id, held_out, lang_pred, score, margin.

    Only the text enters a prediction; lang is learned from, where it is not null and
    the row is not held out. lang_pred is `und` with score 0 for a text that is null or
    has no letter (Unicode category L), and where nothing could be learned. score is the winner's share of
    the corrected counts, margin its lead over the second. A text without a known
    n-gram gets the first language by code point and score 0; ties go to it too.

    Whole texts of any length are counted. Repeated rows are predicted alike, a null
    doc_id stays null, other columns are ignored. An empty table gives no rows. One
    pass, no shuffle.
    """
    filters = fit(df, held_out, **parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(as_bytes(batch.column("text"))):
                some = np.array([lettered(x) for x in texts])
                names, score, margin = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if filters:
                    share = filters.counts(*grams(texts))
                    total, best = share.sum(axis=1), share.argmax(axis=1)
                    top = np.sort(share, axis=1)[:, ::-1]
                    known = some & (total > 0)
                    score[known] = top[known, 0] / total[known]
                    margin[known] = top[known, 0] - (top[known, 1] if share.shape[1] > 1 else 0)
                    names = [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, len(texts)) for c in ("doc_id", "held_out")], pa.array(names, pa.string()), pa.array(score), pa.array(margin)], ["doc_id", "held_out", "lang_pred", "score", "margin"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, held_out boolean, lang_pred string, score double, margin double")
