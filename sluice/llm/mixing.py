"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight is a piecewise linear function of training time from 0 to 1.
Its integral is the source's cumulative demand for words; a document that stands at
word c of its source is trained on when that demand reaches c, so inverting the
integral gives its position. The documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, partitions

#: Default schedules, dealt to the sources in turn: (time, relative weight) at the knots.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source_rank and target of each source, from (source, source_size).

    Weights are dealt in turn to the sources by code point, null last. Together they
    get `share` of all words; no target exceeds `most` times its source's size, and
    the excess goes to the others by weight until none is above. That is water
    filling: in order of size over weight, the sources up to some place are full and
    the rest get one level times their weight. One row for each source; the two
    orderings run over these totals only.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("source_rank", rank).withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_) - F.col("full")) / F.col("rest"))
    # The level at the first source that isn't full holds for it and all after it.
    s = s.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(all_).getField("level"))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "source_rank", target.alias("target"))


def position(at: Column, target: Column, knots: Column) -> Column:
    """The time at which a source's cumulative demand reaches `at` of its `target` words.

    knots: array of struct(t, w, cum) with cum the integral of w up to t; between knots w is linear.
    """
    reach = F.least(F.lit(1.0), F.greatest(F.lit(0.0), at / target)) * F.element_at(knots, -1).getField("cum")
    k = F.least(F.greatest(F.size(F.filter(knots, lambda x: x.getField("cum") <= reach)), F.lit(1)), F.size(knots) - 1)
    a, b = F.element_at(knots, k), F.element_at(knots, k + 1)
    span = b.getField("t") - a.getField("t")
    slope, w, need = (b.getField("w") - a.getField("w")) / span, a.getField("w"), reach - a.getField("cum")
    root = F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * slope * need))
    step = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / F.greatest(w + root, F.lit(1e-300)))
    return a.getField("t") + F.least(span, step)


def knots_of(schedules: Sequence[Sequence[tuple[float, float]]], rank: Column) -> Column:
    """The knots of the schedule that a source of this rank gets."""
    arrays = []
    for schedule in schedules:
        cum, out, last = 0.0, [], None
        for t, w in schedule:
            if last:
                cum += (t - last[0]) * (w + last[1]) / 2
            out.append(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w"), F.lit(cum).alias("cum")))
            last = (t, w)
        arrays.append(F.array(*out))
    out = arrays[-1]
    for i in range(len(arrays) - 2, -1, -1):
        out = F.when((rank - 1) % len(arrays) == i, arrays[i]).otherwise(out)
    return out


def mixed(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, schedules: Sequence = SCHEDULES, whole: bool = False, size_col: str | None = None, tie_col: str | None = None, seed: int = 17, rows_a_block: int = 1024) -> DataFrame:
    """df with mix (struct): size, source_size, target, taken, copies, position, repeat_position.

    Within a source the documents stand in an order fixed by the seed, end to end and
    again from the start for repeats; the mix takes the words below the target. The
    last document is cut there, unless `whole`: then copies are taken whole or not at
    all, whichever is nearer, so the source is off by half a document at most.
    taken: words taken, repeats counted; copies: of the document, a cut one included.
    position and repeat_position: the training times of its first and second copies
    (null if not taken), with `most` of 2 at most two.

    Sizes are words of the text, or the column size_col (null: 0) if given; then no
    text is needed, and tie_col, a hash of it, orders rows that share a doc_id and a size. A null source is a source of its own; null or empty texts have size 0 and are
    taken never; repeated rows are documents of their own; a source of no words has
    target 0. An empty table gives no rows. Columns of df pass unchanged, and a column
    named mix is replaced.

    The running sum within a source is taken in blocks of about `rows_a_block` rows of
    its order, so a source of a third of all rows is spread like any other; only block
    totals are summed by source.
    """
    if most > 2:
        raise ValueError("a document is repeated once at most")
    names = [c for c in df.columns if c != "mix"]
    key = F.xxhash64(F.lit(seed), F.col("doc.doc_id").cast("string"))
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    size = F.coalesce(F.col(f"doc.{size_col}"), F.lit(0)).cast("long") if size_col else n_words(F.col("doc.text").cast("string"))
    tie = F.col(f"doc.{tie_col}") if tie_col else F.col("size") if size_col else F.xxhash64("doc.text")
    d = d.select("doc", F.col("doc.source").alias("source"), size.alias("size"), key.alias("key"))
    blocks = max(1, d.count() // rows_a_block)
    # 2**20 places of the order, cut evenly into blocks
    place = F.shiftrightunsigned(F.col("key"), 44)
    d = d.withColumn("block", F.floor(place * F.lit(blocks) / F.lit(1 << 20)).cast("int"))
    totals = materialize(d.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "blocks")
    aim = targets(totals.groupBy("source").agg(F.sum("block_size").cast("long").alias("source_size")), weights, share, most)
    start = F.coalesce(F.sum("block_size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aim = aim.withColumn("knots", knots_of(schedules, F.col("source_rank")))
    plan = totals.withColumn("start", start).alias("t").join(aim.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source"))).select(F.col("t.source").alias("of"), F.col("t.block").alias("part"), "start", "source_size", "target", "knots")
    plan = materialize(plan, "mix")
    within = Window.partitionBy("source", "block").orderBy(place, "key", F.col("doc.doc_id"), tie).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("part")))
    d = d.withColumn("before", F.col("before") + F.col("start"))
    size, target = F.col("size"), F.col("target")
    aim_words = F.round(target).cast("long")
    first, again = F.col("before"), F.col("before") + F.col("source_size")
    if whole:
        takes = [F.when((size > 0) & (2 * at + size <= 2 * target), size).otherwise(F.lit(0)) for at in (first, again)]
    else:
        takes = [F.greatest(F.lit(0), F.least(size, aim_words - at)) for at in (first, again)]
    taken, copies = takes[0] + takes[1], (takes[0] > 0).cast("int") + (takes[1] > 0).cast("int")
    times = [F.when(t > 0, position(at.cast("double"), target, F.col("knots"))) for t, at in zip(takes, (first, again), strict=True)]
    mix = F.struct(size.cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), target.alias("target"), taken.cast("long").alias("taken"), copies.alias("copies"), times[0].alias("position"), times[1].alias("repeat_position"))
    return d.select(*[F.col("doc").getField(c).alias(c) for c in names], mix.alias("mix"))


def in_training_order(df: DataFrame, position: str) -> DataFrame:
    """df range-sorted by training position, what is never trained on last."""
    return df.repartitionByRange(partitions(df.sparkSession), F.col(position).asc_nulls_last(), F.hash("doc_id")).sortWithinPartitions(F.col(position).asc_nulls_last(), "doc_id")
