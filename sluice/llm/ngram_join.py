"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Documents with one set of word shingles form a class. Classes whose MinHash values
agree on a band are candidates; their values are compared step by step, and a pair
is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below a tolerance. What survives is grouped, and within the groups
every pair is verified exactly on its shingle sets. Pairs live only as indices
inside a task: what leaves it are a count of links for each class and the edges of
a spanning forest, so a large group of near copies costs rows in proportion to its
size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, as_bytes, in_arrow, materialize, mix, partitions, split_by_filter, text_slices

WORDS_A_SHINGLE = 5
#: Bands of four 16-bit MinHash values, each band one 64-bit word. At similarity 0.8 a pair
#: misses all bands with probability (1 - 0.8**4)**24 = 3e-6, at 0.9 with less than 1e-11.
BANDS, LANES = 24, 4
#: Classes of one bucket or group that meet in one block, and shingles of one block.
BLOCK, BLOCK_SHINGLES = 512, 500_000


class Shingles:
    """64-bit hashes of the shingles of texts, by cached hashes of their words."""

    def __init__(self) -> None:
        self.codes, self.hashes = Codes(300_000), np.zeros(0, np.uint64)

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes of all texts end to end, number for each text), repeats included.

        A text of fewer words than a shingle has one, of all its words; one without words none.
        """
        if self.codes.full:
            self.codes, self.hashes = Codes(300_000), np.zeros(0, np.uint64)
        split = [x.split() if x else [] for x in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        codes = self.codes.of([w for s in split for w in s])
        if len(self.codes) > len(self.hashes):
            from itertools import islice

            new = list(islice(reversed(self.codes), len(self.codes) - len(self.hashes)))[::-1]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        w = self.hashes[codes]
        padded = np.concatenate([w, np.zeros(WORDS_A_SHINGLE - 1, np.uint64)])
        total = np.zeros(len(w), np.uint64)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(w))  # words from here to the text's end
        for k in range(WORDS_A_SHINGLE):
            part = mix(padded[k : k + len(w)], k + 1)
            total += np.where(left > k, part, np.uint64(0)) if k else part
        counts = np.where(n > 0, np.maximum(n - WORDS_A_SHINGLE + 1, 1), 0)
        starts = np.cumsum(n) - n
        at = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return mix(total[at]), counts


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash signatures, BANDS words of LANES 16-bit values, of texts that have shingles."""
    starts = np.cumsum(counts) - counts
    low, out = hashes.astype(np.uint32), np.zeros((len(counts), BANDS), np.uint64)
    scale = mix(np.arange(BANDS * LANES), 11)
    for k in range(BANDS * LANES):
        a, b = np.uint32(int(scale[k]) & 0xFFFFFFFF | 1), np.uint32(int(scale[k]) >> 32)
        least = np.minimum.reduceat((low * a) ^ b, starts).astype(np.uint64)
        out[:, k // LANES] |= (mix(least, k) & np.uint64(0xFFFF)) << np.uint64(16 * (k % LANES))
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = 0, 1, ... compared values: the fewest matches at which P(similarity >= threshold) is at least tolerance.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1), whose upper tail
    is that of a binomial of n + 1 trials.
    """
    out = []
    for n in range(BANDS * LANES + 1):
        tail, m = 0.0, -1
        while tail < tolerance and m <= n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving_pairs(i: np.ndarray, j: np.ndarray, sig: np.ndarray, band: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that Bayesian pruning leaves, each in the first band they share only."""
    matches = np.zeros(len(i), np.int64)
    for w in range(BANDS):
        x = sig[i, w] ^ sig[j, w]
        for lane in range(LANES):
            matches += (x >> np.uint64(16 * lane)) & np.uint64(0xFFFF) == 0
        ok = (matches >= need[LANES * (w + 1)]) & ~((x == 0) & (w < band))
        if not ok.all():
            i, j, matches, band = i[ok], j[ok], matches[ok], band[ok]
    return i, j


def pairs_within(sizes: np.ndarray, sides: np.ndarray, cross: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within consecutive groups of the given sizes, some `most` at a time.

    Of a cross group (cross[g]) only the pairs between its two sides.
    """
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    later = np.repeat(starts + sizes, sizes) - np.arange(len(of)) - 1  # rows of the group after each
    cuts = np.searchsorted(np.cumsum(later), np.arange(most, int(later.sum()) + most, most), side="left") + 1
    lo = 0
    for hi in np.unique(np.minimum(cuts, len(of))):
        n = later[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = ~cross[of[i]] | (sides[i] != sides[j])
        yield i[ok], j[ok]
        lo = hi


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each of n items' component."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        ok = low != high
        if not ok.any():
            break
        np.minimum.at(label, high[ok], low[ok])
        while (label[label] != label).any():
            label = label[label]
    return label


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that come sorted by keys; a group is bounded, so what waits is too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        if held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in keys):
            first = int(change[0]) if len(change) else batch.num_rows
        else:
            first = 0
        if held and (first < batch.num_rows):
            if first:
                held.append(batch.slice(0, first))
            yield pa.Table.from_batches(held)
            held = []
            last = int(change[-1]) if len(change) else 0
            if last > first:
                yield pa.Table.from_batches([batch.slice(first, last - first)])
            held = [batch.slice(max(last, first))]
        elif held:
            held.append(batch)
        else:
            last = int(change[-1]) if len(change) else 0
            if last:
                yield pa.Table.from_batches([batch.slice(0, last)])
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_sizes(table: pa.Table, keys: list[str]) -> np.ndarray:
    k = [table.column(c).to_numpy() for c in keys]
    change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
    return np.diff(np.concatenate([[0], change, [table.num_rows]]))


def described(df: DataFrame) -> DataFrame:
    """doc_id, text_hash, digest of the shingle set (null: none), shingles and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for lo, texts in text_slices(as_bytes(batch.column("text")), 1_500_000):
                hashes, counts = shingles.of(texts)
                sig = np.zeros((len(texts), BANDS), np.uint64)
                some = counts > 0
                if some.any():
                    sig[some] = signatures(hashes, counts[some])
                ends = np.cumsum(counts)
                digests, sizes = [None] * len(texts), np.zeros(len(texts), np.int32)
                for r in np.flatnonzero(some):
                    own = np.unique(hashes[ends[r] - counts[r] : ends[r]])
                    digests[r], sizes[r] = xxhash.xxh3_128_digest(own.tobytes()), len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(texts)), batch.column("text_hash").slice(lo, len(texts)), pa.array(digests, pa.binary()), pa.array(sizes), pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "digest", "shingles", "sig"])

    text = F.col("text").cast("string")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).transform(in_arrow, run, "doc_id long, text_hash long, digest binary, shingles int, sig array<long>")


def blocked(members: DataFrame, keys: list[str], blocks) -> DataFrame:
    """members dealt to pairs (s, t) of blocks of their group; side is the block of the member itself."""
    m = members.withColumn("blocks", blocks.cast("int"))
    m = m.withColumn("side", F.pmod(F.xxhash64("node", *keys), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("s", F.least("side", "other")).withColumn("t", F.greatest("side", "other")).drop("blocks", "other")
    at = [*keys, "s", "t"]
    return m.repartition(partitions(members.sparkSession), *at).sortWithinPartitions(*at, "node")


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of the pairs of classes that pruning leaves."""
    spark = classes.sparkSession
    banded = classes.select("node", F.posexplode("sig").alias("band", "word"))
    shared = materialize(banded.groupBy("band", "word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = banded.join(shared, ["band", "word"]).join(classes.select("node", "sig"), "node")
    keys, need = ["band", "word", "s", "t"], least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, keys):
            node, sides = table.column("node").to_numpy(), table.column("side").to_numpy()
            sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BANDS)
            band, cross = table.column("band").to_numpy(), table.column("s").to_numpy() != table.column("t").to_numpy()
            sizes = group_sizes(table, keys)
            found = [surviving_pairs(i, j, sig, band[i], need) for i, j in pairs_within(sizes, sides, cross[np.cumsum(sizes) - sizes])]
            if found:
                label = forest(len(node), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
                some = np.flatnonzero(label != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]])], ["a", "b"])

    out = blocked(members.select("band", "word", "node", "sig", "n"), ["band", "word"], F.ceil(F.col("n") / BLOCK)).select(*keys, "side", "node", "sig").transform(in_arrow, run, "a long, b long")
    return materialize(out.distinct(), "candidates")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have an edge: one label for each connected component.

    Every node moves to the neighbour, or itself, that comes first in a random order,
    and the edges follow, until none is left. A star ends in one round, and a random
    order ends any shape in a number of rounds like the logarithm of its size.
    """
    spark = edges.sparkSession
    edges = edges.filter("a <> b")
    labels, step = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels"), 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("h"), c.alias("id"))  # noqa: B023, E731
        to = both.groupBy("a").agg(F.least(F.min(order(F.col("b"))), F.min(order(F.col("a")))).getField("id").alias("to"))
        to = materialize(to.withColumnRenamed("a", "from"), "moves")
        a, b = to.select(F.col("from").alias("a"), F.col("to").alias("x")), to.select(F.col("from").alias("b"), F.col("to").alias("y"))
        edges = materialize(edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        labels = materialize(labels.join(to, labels["label"] == to["from"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        step += 1
    return labels if step else spark.createDataFrame([], "node long, label long")


def exact_links(sets: list[np.ndarray], i_side: np.ndarray, j_side: np.ndarray, ratio: tuple[int, int]) -> np.ndarray:
    """Boolean matrix: which of the sets at i_side and j_side have Jaccard similarity at least ratio."""
    size = np.array([len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1  # a shingle of one set alone adds to no intersection
    row, column = np.repeat(np.arange(len(sets)), size)[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter, width = np.zeros((len(i_side), len(j_side)), np.float32), 8192
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        inter += m[i_side] @ m[j_side].T
    inter = inter.astype(np.int64)
    union = size[i_side][:, None] + size[j_side][None, :] - inter
    return inter * ratio[1] >= union * ratio[0]


def verified(df: DataFrame, groups: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """(node, links, root): each class's documents at similarity ratio or more, and an edge to the least class it reaches.

    groups: node, label, size, shingles, rep (doc_id, text_hash). The representatives'
    texts are read again, so only documents that have candidates carry shingles about.
    """
    total = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    plan = materialize(groups.join(materialize(total, "groups"), "label").select("node", "label", "size", blocks.alias("blocks"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")), "plan")
    text = F.col("text").cast("string")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    docs, _ = split_by_filter(docs, "text_hash", plan, "rep_hash")  # only those are shuffled
    read = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))).select("node", "label", "size", "blocks", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for lo, texts in text_slices(as_bytes(batch.column("text"))):
                hashes, counts = shingles.of(texts)
                ends = np.cumsum(counts)
                sets = [np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, len(texts)) for c in ("node", "label", "size", "blocks")], pa.array(sets, pa.binary())], ["node", "label", "size", "blocks", "set"])

    members = read.transform(in_arrow, shingle, "node long, label long, size long, blocks long, set binary")
    keys = ["label", "s", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, keys):
            lo = 0
            for n in group_sizes(table, keys):
                part = table.slice(lo, n)
                lo += int(n)
                node, first = np.unique(part.column("node").to_numpy(), return_index=True)  # repeated rows give a class twice
                part = part.take(first)
                side, s, t = part.column("side").to_numpy(), part.column("s")[0].as_py(), part.column("t")[0].as_py()
                i, j = np.flatnonzero(side == s), np.flatnonzero(side == t)
                if not len(i) or not len(j) or len(node) < 2:
                    continue
                size = part.column("size").to_numpy()
                linked = exact_links([np.frombuffer(x.as_py(), np.uint64) for x in part.column("set")], i, j, ratio)
                if s == t:
                    np.fill_diagonal(linked, False)
                links = np.zeros(len(node), np.int64)
                links[i] += linked @ size[j]
                if s != t:
                    links[j] += size[i] @ linked
                x, y = np.nonzero(linked)
                label = forest(len(node), i[x], j[y])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], ["node", "links", "root"])

    out = blocked(members, ["label"], F.col("blocks")).select(*keys, "side", "node", "size", "set").transform(in_arrow, run, "node long, links long, root long")
    return materialize(out, "links")


def classes_and_rows(df: DataFrame, ratio: tuple[int, int] = (4, 5), tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, digest of every row; digest, class_id, n_links, group_size of every class)."""
    rows = materialize(described(df), "shingles")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("low_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("size"), F.min("shingles").alias("shingles"), F.min("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    near = components(candidate_edges(classes, ratio[0] / ratio[1], tolerance))
    links = verified(df, near.join(classes.drop("sig"), "node").select("node", "label", "size", "shingles", "rep"), ratio)
    final = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    light = classes.select("node", "digest", "low_id", "size")
    grouped = light.join(final, "node").join(counted, "node", "left")
    low = grouped.groupBy("label").agg(F.min("low_id").alias("class_id"), F.sum("size").alias("group_size"))
    grouped = grouped.join(low, "label").select("node", "class_id", "links", "group_size")
    out = light.join(materialize(grouped, "grouped"), "node", "left").select(
        "digest", F.coalesce("class_id", "low_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("group_size", "size").alias("group_size"))
    return rows.select("doc_id", "text_hash", "digest"), materialize(out, "classes")


def jaccard_join(df: DataFrame, ratio: tuple[int, int] = (4, 5), tolerance: float = 1e-9) -> DataFrame:
    """One row for each row of df (doc_id, text): doc_id, class_id, n_links, group_size.

    Shingles are five words in a row, words being runs of other than ASCII white space;
    a text of fewer words has one shingle, of all of them. Two documents are linked if
    the Jaccard similarity of their shingle sets is at least ratio (a fraction, so
    that the comparison is exact). n_links counts the other documents linked to a
    document; class_id is the smallest doc_id of its connected component, of
    group_size documents.

    A null, empty or blank text has no shingles and stands alone with 0 links. A null
    doc_id is linked like any other but names a class only if no other id is there.
    Repeated rows are documents of their own, linked with each other. An empty table
    gives no rows. Other columns are ignored.
    """
    rows, classes = classes_and_rows(df, ratio, tolerance)
    # Rows without shingles join nothing; they would all meet in the task of the null key.
    alone = rows.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("group_size"))
    return rows.join(classes, "digest").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("group_size").cast("long").alias("group_size")).unionByName(alone)


def keep_one(df: DataFrame, ratio: tuple[int, int] = (4, 5), tolerance: float = 1e-9) -> DataFrame:
    """df without the documents whose component holds a smaller doc_id; df's columns as they are.

    Null, empty and blank texts have no shingles and stay, as does a text of any length
    that nothing is linked to; an empty table gives no rows. Rows that a filter of those hashes lets pass are not shuffled. Rows with a null doc_id stay, and so do rows that repeat the id that stays.
    """
    rows, classes = classes_and_rows(df, ratio, tolerance)
    gone = rows.join(classes.filter("group_size > 1"), "digest").filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash"))
    gone = materialize(gone.distinct(), "gone")
    # The document in one column, so that none of its own can clash with ours.
    hashed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__own"))
    may, stay = split_by_filter(hashed, "__own", gone, "__hash")
    left = may.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__own") == F.col("__hash")), "left_anti")
    return left.unionByName(stay).select(*[F.col("doc").getField(c).alias(c) for c in df.columns])
