"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table of (line hash, documents that hold it), bucketed and sorted by hash.
A batch of documents is counted, merge-anti-joined with the hashes that the runs
already know to be frequent, and added as a run of the first level; as soon as a level
has `fanout` runs they are merged into one of the next. Runs are never shuffled or
sorted again: equal buckets meet in one task, each in its order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, partitions, remove, scratch_path, split_by_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(bare: Column) -> Column:
    """The key of a line that has no ASCII white space at its ends: A-Z in lower case."""
    # Lowering is much faster than translating, and the same for lines of ASCII only.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(text: Column, least: int) -> Column:
    """An array of the hashes of a text's lines: the MD5 of the line's key, null for keys of fewer than `least` code points, which never count.

    In steps, so that each line's parts are made once.
    """
    keys = F.transform(F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(SPACES))), key_of)
    return F.transform(keys, lambda x: F.when(F.length(x) >= least, F.unhex(F.md5(x.cast("binary")))))


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of bucketed tables with one file a bucket are taken as sorted while this lasts."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Lines of a store that each of its buckets holds at most, on average, before their number is doubled.
BUCKET_LINES = 4_000_000


class LineRuns:
    """The levels of runs, a store in the shared folder that outlasts executors.

    `counted` are the runs of lines that are not known to be frequent, `known` those of
    lines that are. A batch is merge-anti-joined with the known ones; what is left is added
    to the counted runs, and those of its lines whose documents, summed over all runs,
    reach `enough` become known. So no run is ever rewritten but by compaction.

    With a path it outlasts the process too: a later LineRuns of that path goes on with
    the runs it finds there. What the store holds is what its newest manifest names; one
    is written for a whole call, with the call's name, so a call that was cut short leaves
    the store as it was, and one that is made again is known. One process adds at a time.
    """

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 2, path: str | None = None):
        self.spark, self.enough, self.fanout, self.own = spark, enough, fanout, path is None
        self.path = path.rstrip("/") if path else scratch_path(spark, "runs")
        self.counted: list[list[str]] = [[]]
        self.known: list[list[str]] = [[]]
        self.calls: list[str] = []
        self.version, self.buckets, self.lines = 0, partitions(spark), 0
        self.made: set[str] = set()
        self.stored: set[str] = set()
        if path:
            self._open()

    def _all(self) -> list[str]:
        return [r for levels in (self.counted, self.known) for level in levels for r in level]

    def _open(self) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder) or not files.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")):
            return
        found = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/manifest-*").collect()]  # two at most
        newest = max(found, key=lambda x: x["version"])
        for name in ("version", "counted", "known", "calls", "buckets", "lines"):
            setattr(self, name, newest[name])
        self.stored = set(self._all())
        for left in files.listStatus(folder):  # by a process that was killed
            if left.getPath().getName().startswith("sluice_run_") and left.getPath().getName() not in self.stored:
                files.delete(left.getPath(), True)
        for run in self.stored:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (line BINARY, n_docs BIGINT) USING parquet CLUSTERED BY (line) SORTED BY (line) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")

    def commit(self, call: str) -> None:
        """Name the runs that now count, and the call; then delete those that don't count any more."""
        if self.lines > BUCKET_LINES * self.buckets:
            self._double()
        self.version, self.calls = self.version + 1, [*self.calls, call]
        text = json.dumps({name: getattr(self, name) for name in ("version", "counted", "known", "calls", "buckets", "lines")})
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{self.path}/manifest-{self.version:08d}")
        remove(self.spark, f"{self.path}/manifest-{self.version - 1:08d}")
        self.drop((self.stored | self.made) - set(self._all()))
        self.stored, self.made = set(self._all()), set()

    def drop(self, runs: set[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            remove(self.spark, f"{self.path}/{run}")

    def _write(self, rows: DataFrame) -> str:
        """A new run of rows that lie in their buckets' tasks."""
        name = f"sluice_run_{uuid.uuid4().hex}"
        self.made.add(name)
        rows.select("line", "n_docs").write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, "line").sortBy("line").saveAsTable(name)
        return name

    def _double(self) -> None:
        """All runs anew, in twice as many buckets: done so rarely that each line is rewritten once or twice for it."""
        while self.lines > BUCKET_LINES * self.buckets:
            self.buckets *= 2
        for levels in (self.counted, self.known):
            levels[:] = [[self._write(self.spark.table(r).repartition(self.buckets, "line")) for r in level] for level in levels]

    def merged(self, a: str, b: str) -> DataFrame:
        """The merge join of two runs."""
        x, y = self.spark.table(a).alias("x"), self.spark.table(b).hint("merge").alias("y")
        both = x.join(y, F.col("x.line") == F.col("y.line"), "full_outer")
        count = F.coalesce(F.col("x.n_docs"), F.lit(0)) + F.coalesce(F.col("y.n_docs"), F.lit(0))
        return both.select(F.coalesce("x.line", "y.line").alias("line"), count.alias("n_docs"))

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose line isn't known to be frequent, in their buckets' tasks."""
        batch = batch.repartition(self.buckets, "line")
        for run in (r for level in self.known for r in level):
            batch = batch.join(self.spark.table(run).hint("merge"), "line", "left_anti")
        return batch

    def reached(self, run: str) -> DataFrame:
        """Of a run, the lines that `enough` documents of all counted runs hold: one merge join with each, which only streams."""
        out = self.spark.table(run)
        for other in (r for level in self.counted for r in level if r != run):
            theirs = self.spark.table(other).select(F.col("line").alias("of"), F.col("n_docs").alias("more")).hint("merge")
            out = out.join(theirs, F.col("line") == F.col("of"), "left").select("line", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"))
        return out.filter(F.col("n_docs") >= self.enough)

    def _compact(self, levels: list[list[str]]) -> None:
        """Every level with `fanout` runs becomes one run of the next."""
        i = 0
        while i < len(levels):
            if len(levels[i]) >= self.fanout:
                if i + 1 == len(levels):
                    levels.append([])
                one, *rest = levels[i]
                for run in rest:
                    one = self._write(self.merged(one, run))
                levels[i + 1].append(one)
                levels[i] = []
            i += 1

    def add(self, batch: DataFrame) -> None:
        """Take in a batch's (line, n_docs), each line once. It counts for good with the next commit."""
        with sorted_buckets(self.spark):
            run = self._write(self.unknown(batch))
            self.lines += self.spark.table(run).count()  # of the files' footers
            self.counted[0].append(run)
            self.known[0].append(self._write(self.reached(run)))
            self._compact(self.counted)
            self._compact(self.known)

    def frequent(self) -> DataFrame:
        """The lines of at least `enough` documents, written: those of the known runs, which have no line in common."""
        out = self.spark.createDataFrame([], "line binary")
        for run in (r for level in self.known for r in level):
            out = out.unionByName(self.spark.table(run).select("line"))
        return materialize(out, "frequent")

    def close(self) -> None:
        """Forget the tables; delete what was made and not committed, and all runs if the store has no path of its own."""
        self.drop(self.made)
        for run in self._all():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        if self.own:
            remove(self.spark, self.path)


def dedup_lines(df: DataFrame, enough: int = 10, least: int = 1, batches: int = 4, fanout: int = 2, text_col: str = "text", store: str | None = None, call: str | None = None) -> DataFrame:
    """df with lines (struct): n_lines, n_dropped, kept (the text of the lines that stay).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case.
    Keys of at least `least` code points that at least `enough` documents hold lose all
    their lines in every document; a document counts once however often it repeats a
    key. Blank lines stay. A null or empty text is one empty line; repeated rows count
    as documents of their own; doc_id may be null. df's columns pass unchanged, and a
    column named lines is replaced. An empty table gives no rows.

    df is counted in so many batches. With a store, a path of the shared folder, the
    documents of earlier calls count too, and these are added for later ones. A call is
    added once: made again under its name, or, without one, over the same lines, it finds
    its documents counted, whether the first attempt ended or failed half-way. Give `call`
    where the same documents are to count again.

    Lines travel as hashes of 16 bytes. A document's frequent lines come back to it as
    places, by doc_id and a hash of its text; only documents that a Bloom filter lets
    through are joined with them. The places are held in one row, as its lines are.
    """
    names = [c for c in df.columns if c != "lines"]
    text = F.col(f"doc.{text_col}").cast("string")
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    docs = docs.select("doc", F.col("doc.doc_id").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    hashes = hashed_lines(F.col("text"), least)
    held = docs.select(F.pmod(F.xxhash64("id", "text_hash"), F.lit(batches)).alias("batch"), F.explode(F.array_distinct(F.array_compact(hashes))).alias("line"))
    counts = materialize(held.groupBy("batch", "line").agg(F.count(F.lit(1)).alias("n_docs")), "lines")
    runs = LineRuns(df.sparkSession, enough, fanout, store)
    try:
        if store and call is None:
            call = "lines-{n}-{all}".format(**counts.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line", "n_docs", "batch")).alias("all")).first().asDict())
        if call not in runs.calls:
            for b in range(batches):
                runs.add(counts.filter(F.col("batch") == b).select("line", "n_docs"))
            if store:
                runs.commit(call)
        frequent = runs.frequent()
    finally:
        runs.close()
    places = docs.select("id", "text_hash", F.posexplode(hashes).alias("place", "line")).filter("line IS NOT NULL").join(frequent, "line", "left_semi")
    drops = materialize(places.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.collect_set("place").alias("drops")), "drops")
    may, stay = split_by_filter(docs, "text_hash", drops, "of_hash")
    # Drops grow with the documents, so they are merged with them at every size.
    # The lines are split before the join, so that looking one up by its place doesn't split the text again.
    may = may.select("doc", "id", "text_hash", lines_of(F.col("text")).alias("all")).join(drops.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.coalesce("drops", F.array().cast("array<int>")))
    may = may.select("doc", F.size("all").alias("n"), F.size(left).alias("m"), F.array_join(F.transform(left, lambda i: F.col("all")[i]), "\n").alias("kept"))
    n = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(1))
    stay = stay.select("doc", n.alias("n"), n.alias("m"), F.coalesce("text", F.lit("")).alias("kept"))
    made = F.struct(F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.col("m")).cast("long").alias("n_dropped"), "kept")
    return may.unionByName(stay).select(*[F.col("doc").getField(c).alias(c) for c in names], made.alias("lines"))


#: DuckDB SQL for the query's rows over documents; rows are told apart by a number, as doc_id may be null or repeated.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (
  SELECT r, doc_id, i, d.x[i] AS line, lower_ascii.k AS k
  FROM d, LATERAL (SELECT unnest(range(1, len(d.x) + 1)) AS i) n,
       LATERAL (SELECT translate(trim(d.x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k) lower_ascii
), f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k
GROUP BY l.r, l.doc_id
"""
