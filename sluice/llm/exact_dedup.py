"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

The first pass finds the filter slots that more than one row hits; the second
tests each row against them. Only rows whose slots are all shared may have a copy:
they alone are shuffled by their digest, all others pass straight through.

A filter is broadcast, so it is bounded. The digests are cut into as many ranges as
it takes for each range's filter to keep that bound, and are tested range by range.
They lie sorted in their files, so each range reads its own part of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import BITMAP, BROADCAST_BYTES, bitmap_bit, materialize, scratch_path

#: Ranges are told by the first three hexadecimal digits, which the slots don't depend on: 4096 at most, for 130 thousand million rows.
DIGITS = 3


def slots_of(digest: Column, bits: int) -> list[Column]:
    """The two slots, from 0 to 2**bits - 1, of a hexadecimal digest."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") % F.lit(1 << bits) for i in range(2)]


def filter_bits(rows: int, per_row: int = 16) -> int:
    """log2 of the number of slots: 16 or more for each row."""
    return max(15, (max(1, rows) * per_row - 1).bit_length())


def shared_slots(digests: DataFrame, bits: int) -> DataFrame:
    """The filter: bitmaps (bucket, bits) of the slots that at least two rows hit.

    Slots are counted where their rows are and only their numbers are shuffled.
    """
    both = digests.select(F.explode(F.array(*slots_of(F.col("sha"), bits))).alias("slot"))
    hit = both.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hit.select(F.expr(f"slot div {BITMAP}").alias("bucket"), F.expr(f"slot % {BITMAP}").alias("bit")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def tested(digests: DataFrame, bloom: DataFrame, bits: int) -> DataFrame:
    """digests with a boolean `again`: both slots of the row are shared."""
    out = digests.withColumn("again", F.lit(True))
    for i in range(2):
        slot = slots_of(F.col("sha"), bits)[i]
        # 2**bits slots, which maybe_repeated keeps to BROADCAST_BYTES
        side = F.broadcast(bloom.select(F.col("bucket").alias("b"), F.col("bitmap").alias("m")))
        out = out.withColumn("slot", slot).join(side, F.expr(f"slot div {BITMAP}") == F.col("b"), "left")
        hit = bitmap_bit(F.col("m"), F.expr(f"slot % {BITMAP}"))
        out = out.withColumn("again", F.col("again") & hit).drop("slot", "b", "m")
    return out


def maybe_repeated(digests: DataFrame) -> DataFrame:
    """digests (sha and more) with a boolean `again`, false only for rows whose digest no other row has; written."""
    spark, sorted_ = digests.sparkSession, materialize(digests.sortWithinPartitions("sha"), "digests")
    bits, ranges = filter_bits(sorted_.count()), 1
    while (1 << bits) // 8 > BROADCAST_BYTES and ranges < 16**DIGITS:
        bits, ranges = bits - 1, 2 * ranges
    base, step = scratch_path(spark, "tested"), 16**DIGITS // ranges
    for r in range(ranges):
        low, high = f"{r * step:0{DIGITS}x}", f"{(r + 1) * step:0{DIGITS}x}"
        part = sorted_.filter((F.col("sha") >= low) & (F.col("sha") < high) if r + 1 < ranges else F.col("sha") >= low)
        tested(part, materialize(shared_slots(part, bits), "bloom"), bits).write.option("compression", "zstd").parquet(f"{base}/{low}")
    schema = StructType([*digests.schema, StructField("again", BooleanType())])
    return spark.read.schema(schema).parquet(*[f"{base}/{r * step:0{DIGITS}x}" for r in range(ranges)])


def digest_of(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)


def groups_of(again: DataFrame) -> DataFrame:
    """sha, the row to keep and the size of each group of equal digests.

    Pre-aggregated where the rows are; written, so that both sides of a join with it are
    plain exchanges and a hot digest's rows can be split over tasks at run time.
    """
    return materialize(again.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with
    the largest doc_id stays (null ids are the smallest); of repeated rows with that
    id exactly one. Empty and very long texts are ordinary texts. Other columns are
    ignored. An empty table gives no rows.

    Equality is that of SHA-256. The digests are written to the shared folder (about
    50 bytes a row), so no later stage reads a text again.
    """
    rows = maybe_repeated(df.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("sha"), F.monotonically_increasing_id().alias("row")))
    once = rows.filter(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    again = rows.filter("again").select("doc_id", "sha", "row")
    twice = again.join(groups_of(again), "sha").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return once.unionByName(twice)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that have an equal text with a larger id; its columns as they are.

    Same rules as exact_dedup, for nulls, empty and long texts, ties, repeated rows and
    empty tables. No text is ever shuffled: the rows are written once with their number,
    the copies' numbers become bitmaps of one bit a row, and the rows are read again
    without those. Where the bitmaps pass BROADCAST_BYTES, stretches of rows take turns.
    """
    names = df.columns
    rows = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), digest_of(text_col).alias("sha"), F.monotonically_increasing_id().alias("row")), "rows")
    again = maybe_repeated(rows.select(F.col("doc").getField(id_col).alias("doc_id"), "sha", "row")).filter("again").select("doc_id", "sha", "row")
    gone = again.join(groups_of(again), "sha").filter("row <> keep.row").select("row")
    bitmaps = gone.select(F.expr(f"row div {BITMAP}").alias("b"), F.expr(f"row % {BITMAP}").alias("bit")).groupBy("b").agg(F.expr("bitmap_construct_agg(bit)").alias("m"))
    return without(rows.drop("sha"), materialize(bitmaps, "copies")).select(*[F.col("doc").getField(c).alias(c) for c in names])


def without(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """rows (row and more) whose number has no bit in the bitmaps (b, m)."""
    most = max(1, BROADCAST_BYTES // (BITMAP // 8))
    edges = cuts(bitmaps, most)
    parts = []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        # Rows are numbered in the order of their files, so that a stretch reads only its own.
        some, side = rows, bitmaps
        if low is not None:
            some, side = some.filter(F.col("row") >= low * BITMAP), side.filter(F.col("b") >= low)
        if high is not None:
            some, side = some.filter(F.col("row") < high * BITMAP), side.filter(F.col("b") < high)
        # `most` bitmaps at most, so BROADCAST_BYTES (checked by cuts)
        left = some.join(F.broadcast(side), F.expr(f"row div {BITMAP}") == F.col("b"), "left")
        left = left.filter(~bitmap_bit(F.col("m"), F.expr(f"row % {BITMAP}"))).drop("b", "m")
        parts.append(materialize(left, "kept") if edges else left)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cuts(bitmaps: DataFrame, most: int) -> list[int]:
    """The bucket numbers at which to cut the bitmaps so that no stretch holds more than `most`; none if all may stay together."""
    n = bitmaps.count()
    if n <= most:
        return []
    # A histogram over the table's own files: places in a sorted copy, one number for each cut.
    ordered = bitmaps.select("b").repartitionByRange("b").sortWithinPartitions("b").select("b", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    ordered = materialize(ordered.withColumn("i", F.col("i").bitwiseAND(F.lit((1 << 33) - 1))), "order")
    sizes = {r["p"]: r["n"] for r in ordered.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    start, starts = 0, {}
    for p in sorted(sizes):
        starts[p] = start
        start += sizes[p]
    place = F.col("i") + F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("p"))
    return [r["b"] for r in ordered.filter((place > 0) & (place % F.lit(most) == 0)).select("b").orderBy("b").collect()]  # n / most rows


#: DuckDB SQL for the rows of exact_dedup over documents.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
