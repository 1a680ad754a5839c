"""Spelling variants by full neighbourhood generation.

Every word emits all texts that one deletion, replacement or insertion over the observed
alphabet makes of it, each once; what is a word itself is near, so no distance is ever
verified. Being near goes both ways: a word's candidates are summed up under the word
that they spell, which then knows the number and the most frequent of its near words.

Candidates are hashes in arrays inside a task. A Bloom filter of the vocabulary, of
bounded size, says which may be words; only those are written out as text, shuffled and
joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP, in_arrow, materialize, mix, partitions

#: What separates runs of letters.
GAP = "[^A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: log2 of the most slots of the filter: 64 MB. With over 2**25 words it keeps that size and lets more candidates through.
MOST_BITS = 29
#: The factor of the polynomial hash of a word's code points, an odd number.
BASE = 0x9E3779B97F4A7C15 | 1
#: Candidates that are hashed at once.
AT_ONCE = 1 << 18


def lowered(text: Column) -> Column:
    """With A to Z in lower case and no other letter changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased, of which a letter is left out where `every` divides the crc32 of `<id>:<run>`.

    Counted where the texts are before any shuffle, so that no frequent word is a hot key.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.col(text_col).cast("string"), GAP)).alias("run")).filter("run <> ''")
    rows = rows.select(lowered(F.col("run")).alias("run"), F.col("id")).filter(F.char_length("run") >= least_length)
    h = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    damaged = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return h.select(damaged.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def powers(n: int) -> np.ndarray:
    """BASE to the powers from 0 to n, modulo 2**64."""
    out = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n, BASE, np.uint64), out=out[1:])
    return out


def hash_of(words: list[str]) -> np.ndarray:
    """The hash of each word: its code points as digits to the base BASE, finalised."""
    out = np.empty(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            x = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64)
            out[i] = (x * powers(len(x))[len(x) - 1 :: -1]).sum(dtype=np.uint64) if len(x) else 0
    return mix(out)


def neighbourhood(word: str, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hashes, places, letters, kind) of all distinct texts one edit away, in parts: kind 0 deletes at a place, 1 replaces there, 2 inserts before it.

    In a run of equal letters only the last is deleted, and a letter is only inserted
    behind a run of itself, so that no text comes twice.
    """
    x = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, p = len(x), powers(len(x) + 1)
    with np.errstate(over="ignore"):
        # before[i]: the digits before place i as the highest of a text of n digits; after[i]: those from place i on.
        digits = x * p[n - 1 :: -1][:n] if n else x
        after = np.concatenate([np.cumsum(digits[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])
        before = after[0] - after
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        at = np.arange(n)
        gone = at[np.concatenate([x[1:] != x[:-1], np.ones(min(n, 1), bool)])] if n else at
        yield mix(before[gone] * inverse + after[gone + 1]), gone, np.zeros(len(gone), np.uint64), 0
        step = max(1, AT_ONCE // max(1, len(alphabet)))
        for lo in range(0, n + 1, step):
            place = np.arange(lo, min(n, lo + step))
            own = before[place] + after[place + 1]
            hashes, other = own[:, None] + alphabet[None, :] * p[n - 1 - place][:, None], alphabet[None, :] != x[place][:, None]
            i, j = np.nonzero(other)
            yield mix(hashes[i, j]), place[i], alphabet[j], 1
            place = np.arange(lo, min(n + 1, lo + step))
            hashes = (before[place] * np.uint64(BASE) + after[place])[:, None] + alphabet[None, :] * p[n - place][:, None]
            then = np.concatenate([x, np.zeros(1, np.uint64)])[place]
            i, j = np.nonzero(alphabet[None, :] != then[:, None])
            yield mix(hashes[i, j]), place[i], alphabet[j], 2


def edited(word: str, place: int, letter: int, kind: int) -> str:
    return word[:place] + ("" if kind == 0 else chr(letter)) + word[place + (kind < 2) :]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(spelt, word, n) for each word and each text near it that may be a word; a filter's false positives spell none."""
    spark = vocabulary.sparkSession
    count = vocabulary.count()
    bits = min(MOST_BITS, max(15, (16 * max(1, count) - 1).bit_length()))
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # those of GAP: 128 at most
    alphabet = np.array(sorted({ord(r.c) for r in letters if r.c}), np.uint64)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (hash_of(batch.column("word").to_pylist()) & np.uint64((1 << bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own // BITMAP), pa.array(own % BITMAP)], ["bucket", "bit"])

    parts = vocabulary.select("word").transform(in_arrow, slots, "bucket long, bit long").groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    whole = bytearray((1 << bits) // 8)  # 2**MOST_BITS slots at most, held once
    for r in parts.toLocalIterator():
        whole[r.bucket * BITMAP // 8 : (r.bucket + 1) * BITMAP // 8] = r.bitmap
    sent = spark.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mask = np.frombuffer(sent.value, np.uint8), np.uint64((1 << bits) - 1)
        for batch in batches:
            spelt, word, n = [], [], []
            for w, own in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for hashes, places, letters, kind in neighbourhood(w, alphabet):
                    slot = hashes & mask
                    may = np.flatnonzero(bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    spelt += [edited(w, p, c, kind) for p, c in zip(places[may].tolist(), letters[may].tolist(), strict=True)]
                    word += [w] * len(may)
                    n += [own] * len(may)
                if len(spelt) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(spelt, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["spelt", "word", "n"])
                    spelt, word, n = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(spelt, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["spelt", "word", "n"])

    # Dealt anew: a vocabulary of a few MB would lie in one task, and there is much to do for each word.
    return vocabulary.repartition(partitions(spark), "word").transform(in_arrow, run, "spelt string, word string, n long")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling.

    A form is at least twice as frequent as its word, so there is no circle, and no more
    than 64 steps, which are 6 rounds.
    """
    hops = materialize(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        then = hops.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = hops.join(then.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        hops = materialize(joined, "hops")
        if not hops.filter("moved").limit(1).count():
            return hops.select("word", "root")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row for each word of df's texts: word, form, root, n, n_near, form_n.

    Words as in `words`. Two are near if one inserted, deleted or replaced code point
    makes one of the other. form is the near word of the largest n, of equal ones the
    first in code-point order, if its n is at least twice the word's; root follows forms to
    the last. A null text has no words and a null id is written as nothing; repeated rows
    count again. Very long runs are taken whole, their neighbourhood in parts. Other
    columns are ignored; an empty table gives no rows.
    """
    vocabulary = materialize(words(df, id_col, text_col, **parameters), "vocabulary")
    # A word has as many near ones as its neighbourhood holds at most; they are summed up where they are made first.
    near = near_words(vocabulary).groupBy("spelt").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))).alias("best"))
    # Merged: Spark guesses sizes from the vocabulary's compressed files, and would broadcast many candidates a word.
    out = vocabulary.join(near.hint("merge"), F.col("word") == F.col("spelt"), "left")
    form = (F.col("best").isNotNull()) & (-F.col("best.less") >= 2 * F.col("n"))
    found = materialize(out.select("word", F.when(form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, -F.col("best.less")).alias("form_n")), "forms")
    roots = rooted(found.filter("form IS NOT NULL")).withColumnRenamed("word", "of")
    return found.join(roots.hint("merge"), F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL for the rows of variants over documents, crc32 included.
ORACLE_SQL = r"""
WITH RECURSIVE crc(i, j, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, j + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE j < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE j = 8),
texts AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
runs AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM texts GROUP BY ALL),
keyed AS (SELECT run, times, list_prepend(4294967295, list_transform(range(1, octet_length(encode(k)) + 1), lambda p: ('0x' || substr(hex(encode(k)), 2 * p::BIGINT - 1, 2))::BIGINT)) AS bytes
  FROM (SELECT run, times, coalesce(doc_id::VARCHAR, '') || ':' || run AS k FROM runs WHERE length(run) >= 5)),
hashed AS (SELECT run, times, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM keyed, steps),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (SELECT a.word, b.word AS near, b.n FROM (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM places) a
    JOIN (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM places) b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, root) AS (SELECT word, coalesce(form, word) FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms r ON r.word = c.root WHERE r.form IS NULL
"""
