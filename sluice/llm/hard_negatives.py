"""Hard negatives by a pivot table.

Every vector gets one more component, which gives all the same length M; a query gets a
zero there. The squared distance of the two is then |q|**2 + M**2 - 2 q.x, so scores fall
as distances grow. The table stores each vector's distances to a few pivots; by the
triangle inequality they bracket the distance, so the score, of any query. Only where the
bracket leaves it open is the product itself taken.

Queries meet rows in blocks of bounded size: each block of rows is joined with each
block of queries, as a stated query set against all rows asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize, partitions

#: Pivots, chosen among so many rows of least hash, each the farthest from those before.
PIVOTS, AMONG = 8, 2_048
#: The most rows and queries of a block.
ROWS, QUERIES = 16_384, 2_048
#: Queries that are bracketed at once in a task.
AT_ONCE = 64


def usable(vector: Column) -> Column:
    """Whether a vector has no null and no non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that gives each the squared length `longest`."""
    return np.c_[x, np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))]


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of x, each the farthest from those before; the first is the farthest from the mean."""
    chosen, away = [], ((x - x.mean(axis=0)) ** 2).sum(axis=1) if len(x) else np.zeros(0)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(away.argmax()))
        new = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        away = new if len(chosen) == 1 else np.minimum(away, new)
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def brackets(own: np.ndarray, away: np.ndarray, length: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each query (its distances to the pivots, its squared length) with each row (its distances)."""
    near, far = np.zeros((len(own), len(away))), np.full((len(own), len(away)), np.inf)
    for k in range(own.shape[1]):
        np.maximum(near, np.abs(own[:, k : k + 1] - away[None, :, k]), out=near)
        np.minimum(far, own[:, k : k + 1] + away[None, :, k], out=far)
    both = length[:, None] + longest
    slack = 1e-9 * (both + 1)  # of rounding
    return (both - far * far) / 2 - slack, (both - near * near) / 2 + slack


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Table:
    """The pivot table of df (vec_id, label, vector of whole numbers): written once, with what its brackets need."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        rows = materialize(df.select("vec_id", "label", F.col("vector").cast("array<double>").alias("vector")), "vectors")
        squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        top = rows.agg(F.max(F.size("vector")).alias("dim"), F.max(squares).alias("longest"), F.count(F.lit(1)).alias("n")).first()
        self.dim, self.longest, self.n = top.dim or 0, top.longest or 0.0, top.n
        padded = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(self.dim) - F.size("vector")))
        few = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(AMONG).select(padded.alias("vector")).collect()  # AMONG rows at most
        self.pivots = choose_pivots(augmented(np.array([r.vector for r in few], float).reshape(len(few), self.dim), self.longest))
        pivots, longest, dim = self.pivots, self.longest, self.dim

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = distances(augmented(matrix(batch.column("vector"), dim), longest), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(away), pa.list_(pa.float64()))], ["vec_id", "label", "vector", "away"])

        self.rows = materialize(rows.withColumn("vector", padded).transform(in_arrow, measure, "vec_id long, label int, vector array<double>, away array<double>"), "pivots")
        # As many blocks as there are partitions at least, and none above ROWS.
        self.per_block = max(256, min(ROWS, math.ceil(self.n / partitions(spark))))


def in_blocks(table: Table, rows: DataFrame, queries: DataFrame, run, schema: str, by: list[str], most: int) -> DataFrame:
    """run(rows, queries) for each block of rows with each block of queries of equal `by`; most: the rows of the largest group of `by`."""
    n_queries = max(1, queries.count())
    across, down = max(1, math.ceil(most / table.per_block)), math.ceil(n_queries / QUERIES)
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    left = rows.withColumn("across", block(across, 1)).select("*", every(down).alias("down"))
    right = queries.withColumn("down", block(down, 2)).select("*", every(across).alias("across"))
    keys = [*by, "across", "down"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def positives_of(table: Table, queries: DataFrame, k: int) -> DataFrame:
    """(anchor_id, place, positive_id, positive_score): the k other rows of the highest score with each query's label."""
    most = (table.rows.groupBy("label").count().agg(F.max("count")).first()[0]) or 1
    dim, longest, pivots = table.dim, table.longest, table.pivots

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(rows) and len(queries):
            x, q, away = matrix(rows["vector"], dim), matrix(queries["vector"], dim), matrix(rows["away"], len(pivots))
            ids, anchors = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            for lo in range(0, len(q), AT_ONCE):
                some = q[lo : lo + AT_ONCE]
                low, high = brackets(distances(np.c_[some, np.zeros(len(some))], pivots), away, (some * some).sum(axis=1), longest)
                for i, anchor in enumerate(anchors[lo : lo + AT_ONCE]):
                    other = ids != anchor
                    floor = np.partition(low[i][other], other.sum() - k)[other.sum() - k] if other.sum() > k else -np.inf
                    may = np.flatnonzero(other & (high[i] >= floor))
                    scores = x[may] @ some[i]
                    top = best(scores, ids[may], k)
                    out[0] += [anchor] * len(top)
                    out[1] += ids[may][top].tolist()
                    out[2] += scores[top].astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score"])

    found = in_blocks(table, table.rows, queries, run, "anchor_id long, positive_id long, positive_score long", ["label"], most)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def negatives_of(table: Table, queries: DataFrame, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The k first rows of another label for each positive whose score is from low to high hundredths of the positive's."""
    windows = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))  # a few for each
    asked = queries.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", *[F.col("p").getField(c).alias(c) for c in ("place", "positive_id", "positive_score")])
    asked = materialize(asked, "asked")
    dim, longest, pivots = table.dim, table.longest, table.pivots
    names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if len(rows) and len(queries):
            x, q, away = matrix(rows["vector"], dim), matrix(queries["vector"], dim), matrix(rows["away"], len(pivots))
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            own = [queries[c].to_pylist() for c in ("vec_id", "label", "place", "positive_id", "positive_score")]
            for lo in range(0, len(q), AT_ONCE):
                some = q[lo : lo + AT_ONCE]
                least, most = brackets(distances(np.c_[some, np.zeros(len(some))], pivots), away, (some * some).sum(axis=1), longest)
                for i, (anchor, label, places, positives, scores) in enumerate(zip(*(c[lo : lo + AT_ONCE] for c in own), strict=True)):
                    # 100 s is from low p to high p for a positive's score p, or for none: all windows lie from `first` to `last`.
                    wide = [(low * p, high * p) for p in scores if low * p <= high * p]
                    if not wide:
                        continue
                    first, last = min(w[0] for w in wide) / 100, max(w[1] for w in wide) / 100
                    may = np.flatnonzero((most[i] >= first) & (least[i] <= last) & (labels != label))
                    exact = x[may] @ some[i]
                    for place, positive, p in zip(places, positives, scores, strict=True):
                        inside = np.flatnonzero((100 * exact >= low * p) & (100 * exact <= high * p))
                        top = inside[best(exact[inside], ids[may][inside], k)]
                        for column, values in zip(out, ([anchor] * len(top), [place] * len(top), [positive] * len(top), [p] * len(top), ids[may][top].tolist(), exact[top].astype(np.int64).tolist()), strict=True):
                            column += values
        return pa.table([pa.array(c, pa.int64()) for c in out], names=names)

    found = in_blocks(table, table.rows, asked, run, ", ".join(f"{c} long" for c in names), [], table.n)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(df: DataFrame, is_query: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for df (vec_id, label, vector of whole numbers).

    Anchors are the rows with is_query. An anchor's positives are the `positives` rows of
    its label with the highest inner product; for each, the `negatives` first rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score are
    returned, so none for a negative positive_score. Equal scores go by the smaller vec_id.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no
    part. Shorter vectors count as filled up with zeros. Rows that share the anchor's
    vec_id are no other rows; an id that stands several times among the anchors is one
    anchor, the row of the least label and vector. Other repeated rows count each. Other
    columns are ignored; an empty table gives no rows. Scores are exact below 2**53.
    """
    part = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"), is_query.alias("asks"))
    part = part.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    table = Table(part)
    asks = part.filter("asks").select("vec_id").distinct()
    queries = table.rows.join(asks, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("q")).select("vec_id", "q.label", "q.vector")
    queries = materialize(queries, "queries")
    found = materialize(positives_of(table, queries, positives), "positives")
    return negatives_of(table, queries, found, negatives, low, high).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def embeddings(df: DataFrame) -> DataFrame:
    """The vectors of the registered query: components floor(256 x), labels of ids divisible by 7 moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return df.filter(usable(F.col("embedding"))).select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("vector"))


#: DuckDB SQL for the rows of mine over embeddings.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n USING (anchor_id) WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3
"""
