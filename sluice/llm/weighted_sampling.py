"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is its words with how often each occurs. For each of `samples` draws a word and
its weight get a random value (Ioffe's scheme: two gamma variables and a uniform one,
functions of word and draw alone); the word of the least value, with the step that its
weight falls on, is the sample. Two texts agree in a draw with a probability equal to
their generalised Jaccard similarity, sum of the lesser weights over sum of the greater.

Words, weights and least values of a document are grouped where its text was sent, so
texts are shuffled once and nothing else is.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD_GAP, materialize, partitions

#: Draws of a fingerprint, dealt to CHUNKS rows of DRAWS each: generated code for more draws at once is too long to be compiled.
CHUNKS, DRAWS = 8, 4
SAMPLES = CHUNKS * DRAWS
#: Of a value, 2**STEP_BITS steps to a unit of its logarithm are told apart.
STEP_BITS = 24
#: Bits of each of the numbers of a word.
BITS = 28
#: A value above LARGEST over the number of a text's words isn't looked at: that the least of a draw is above it has probability exp(-LARGEST).
LARGEST = 30
#: Stretches of the order of documents for each shuffle partition.
STRETCHES = 8


def factors(name: str, n: int = 3) -> list[int]:
    """Odd factors (and an addend) of a multiply-shift hash."""
    digest = hashlib.sha512(name.encode()).digest()
    return [int.from_bytes(digest[8 * i : 8 * i + 8], "little") % (1 << 32) | 1 for i in range(n)]


def hashed(a: str, b: str, c: str, x: str, y: str) -> str:
    """BITS bits of two numbers of BITS bits."""
    return f"shiftright(({a} * {x} + {b} * {y} + {c}) & {(1 << 2 * BITS) - 1}, {BITS})"


def dealt(i: int, name: str = "chunk") -> list[list[int]]:
    """Of number i of a chunk, the factors by chunk."""
    return [list(x) for x in zip(*[factors(f"{name} {c} {i}") for c in range(CHUNKS)], strict=True)]


#: SQL for the uniform variables of a draw, from its hashes v0, v1 and v2; those of u2 and u3, whose ends matter, have all bits.
UNIFORM = (
    f"((shiftright(v0, {BITS // 2}) + 0.5D) / {1 << BITS // 2}D)", f"(((v0 & {(1 << BITS // 2) - 1}) + 0.5D) / {1 << BITS // 2}D)",
    f"((v1 + 0.5D) / {1 << BITS}D)", f"((v2 + 0.5D) / {1 << BITS}D)", f"(((v1 & 4095) * 4096 + (v2 & 4095) + 0.5D) / {1 << 24}D)",
)


def least(j: int) -> str:
    """SQL for what is minimised in draw j of a chunk over a text's words (z, log_w, bound): logarithm of the value, then the sample's code.

    With x = u0 u1 and y = u2 u3, the value is at least (1 - y) x / weight; for a weight of 1 it is -ln(y) x**(1 - u4), so at least
    2 (1 - y) / (1 + y) times x / (1 - u4 + u4 x). Words for which that is too large are left out before any logarithm.
    """
    u = [re.sub(r"v(\d)", rf"v{j}_\1", x) for x in UNIFORM]
    x, y = f"({u[0]} * {u[1]})", f"({u[2]} * {u[3]})"
    r, c = f"(-ln{x})", f"(-ln{y})"
    step = f"floor(log_w / {r} + {u[4]})"
    packed = lambda value, code: f"bigint(floor(({value} + 100D) * {1 << STEP_BITS}D)) * {1 << BITS} + {code}"
    # A weight of 1 is always at step 0.
    once = packed(f"ln({c}) - {r} * (1D - {u[4]})", "z")
    more = packed(f"ln({c}) - {r} * ({step} - {u[4]} + 1D)", f"((z + 7919 * {step}) & {(1 << BITS) - 1})")
    near = f"2D * (1D - {y}) * {x} <= bound * (1D + {y}) * (1D - {u[4]} + {u[4]} * {x})"
    return f"CASE WHEN log_w = 0D THEN CASE WHEN {near} THEN {once} END WHEN (1D - {y}) * {x} <= bound THEN {more} END"


def code(packed: Column) -> Column:
    """The sample, 1 to 65535, of a least value; 0 of a text without words."""
    return F.coalesce(packed.bitwiseAND(F.lit((1 << BITS) - 1)) % 65_535 + 1, F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The share of draws in which two fingerprints, as arrays, agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def hexed(codes: Column) -> Column:
    return F.lower(F.array_join(F.transform(codes, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def place_bounds(rows: DataFrame, stretches: int) -> list:
    """The places at which the order of `place` is cut into about `stretches` equal stretches, the first of all included.

    A histogram over a table of the places alone: sorted ranges, then the row at each cut.
    """
    ordered = rows.select("place").repartitionByRange(partitions(rows.sparkSession), "place").sortWithinPartitions("place")
    ordered = materialize(ordered.select("place", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "places")
    sizes = {r.p: r.n for r in ordered.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    start, starts = 0, {}
    for p in sorted(sizes):
        starts[p] = start
        start += sizes[p]
    if not start:
        return []
    at = F.col("i") + F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("p"))
    return sorted(r.place for r in ordered.filter(at % F.lit(math.ceil(start / stretches)) == 0).select("place").collect())  # `stretches` rows at most


def place_of(doc_id: Column, row: Column) -> Column:
    """Text that sorts as ids descend, null ids last, equal ones by the number of the row."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(F.when(doc_id.isNull(), F.lit("1")).otherwise("0"), digits(F.coalesce(F.bitwise_not(doc_id), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), digits(row))


def stretch_of(place: Column, edges: Column, n: int) -> Column:
    """The number of the stretch that a place lies in, by binary search in the n places that begin one."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < n) & (F.get(edges, F.least(at + step, F.lit(n - 1))) <= place), at + step).otherwise(at))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stretch, at, extra, doc_id, text, next) of df: the rows in descending order of id, with the next row's text.

    One shuffle of the texts, by stretches of the order. The first row of a stretch goes
    to the end of the one before too, as `extra`, and the first of all to the end of the last.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("place", place_of(F.col("doc_id"), F.col("row"))).drop("row")
    bounds = place_bounds(rows, STRETCHES * partitions(df.sparkSession)) or [""]
    edges = F.split(F.lit(",".join(bounds)), ",")
    rows = rows.withColumn("stretch", stretch_of(F.col("place"), edges, len(bounds)))
    first = F.get(edges, F.col("stretch")) == F.col("place")
    before = F.pmod(F.col("stretch") - 1, F.lit(len(bounds)))
    copies = F.when(first, F.array(F.struct(F.col("stretch"), F.lit(False).alias("extra")), F.struct(before.alias("stretch"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("stretch"), F.lit(False).alias("extra"))))
    rows = rows.select("doc_id", "text", "place", F.inline(copies))
    order = Window.partitionBy("stretch").orderBy("extra", "place")
    return rows.select("stretch", F.row_number().over(order).alias("at"), "extra", "doc_id", "text", F.lead("text").over(order).alias("next"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last n_chars / 2 code points, rounded down, are
    replaced by as many of the next document's first ones, or by all of them. The next
    document is that of the next smaller doc_id; null ids come last, equal ids in the
    order of the scan, and the first document follows the last. The near columns are the
    shares of agreeing draws of a text with its edited form and with the next document.

    A null text is an empty one. Texts without words have samples of their own, so they
    agree with each other alone. Very long texts are sampled whole; repeated rows have
    equal fingerprints. Words are runs of other than ASCII white space. Other columns are
    ignored, an empty table gives no rows. df is read twice and has to give the same rows
    in the same order both times, as a table does.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(df, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.when(~F.col("extra"), F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next", F.lit(1), half)))).drop("next")
    trimmed = {c: F.btrim(c, F.lit(SPACES)) for c in ("text", "edited")}
    rows = rows.withColumns({f"{c}_words": F.when(t != "", F.split(t, WORD_GAP)) for c, t in trimmed.items()})
    size = F.least(*[F.greatest(F.coalesce(F.size(f"{c}_words"), F.lit(1)), F.lit(1)) for c in trimmed])
    facts = F.struct("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))
    nothing = F.lit(None).cast("struct<doc_id: bigint, n_chars: bigint, sha: string>")
    sides = [F.struct(F.lit(side).alias("side"), w.alias("words"), f.alias("facts")) for side, w, f in ((0, F.col("text_words"), nothing), (1, F.col("edited_words"), nothing), (2, F.lit(None).cast("array<string>"), facts))]
    apart = rows.select("stretch", "at", size.alias("size"), F.inline(F.when(F.col("extra"), F.array(sides[0])).otherwise(F.array(*sides))))
    # The row of a document's facts has no word; it stays apart from its words' rows, whose facts are null.
    at = ["stretch", "at", "facts"]
    words = apart.select(*at, "size", "side", F.explode_outer("words").alias("word"))
    # All of the next steps group within a stretch, so none of them shuffles.
    terms = words.groupBy(*at, "size", "word").agg(*[F.count(F.when(F.col("side") == i, 1)).alias(f"n{i}") for i in (0, 1)])
    md5 = F.md5(F.col("word").cast("binary"))
    # What is drawn with is never null: a method that is handed a flag beside each of so many columns isn't fully compiled by the JVM.
    known = lambda c, other: F.coalesce(c, F.lit(other))
    numbers = [known(F.conv(F.substring(md5, 1 + 7 * i, 7), 16, 10).cast("long"), 0).alias(c) for i, c in enumerate("xyz")]
    # A word that is as frequent in both texts is drawn for once, as side 2.
    weights = [F.struct(F.lit(i).alias("side"), F.col(f"n{i % 2}").alias("n")) for i in range(3)]
    weighted = F.when(F.col("n0") == F.col("n1"), F.array(weights[2])).when(F.col("n1") == 0, F.array(weights[0])).when(F.col("n0") == 0, F.array(weights[1])).otherwise(F.array(*weights[:2]))
    # No value is below a bound of -1, so nothing is drawn where there is no word.
    bound = known(F.when(F.col("word").isNotNull(), LARGEST * F.col("n") / F.col("size")), -1.0)
    sided = terms.select(*at, "size", "word", *numbers, F.inline(weighted)).select(*at, "side", *"xyz", known(F.ln("n"), 0.0).alias("log_w"), bound.alias("bound"))
    chunk = sided.withColumn("chunk", F.explode(F.array(*map(F.lit, range(CHUNKS)))))
    own = [F.expr(hashed(*[f"array({', '.join(f'{n}L' for n in f)})[chunk]" for f in dealt(i)], "x", "y")).alias(c) for i, c in enumerate("pq")]
    hashes = [F.expr(hashed(*map("{}L".format, factors(f"draw {j} {i}")), "p", "q")).alias(f"v{j}_{i}") for j in range(DRAWS) for i in range(3)]
    drawn = chunk.select(*at, "side", "chunk", "z", "log_w", "bound", *own).select(*at, "side", "chunk", "z", "log_w", "bound", *hashes)
    found = drawn.groupBy(*at, "chunk", "side").agg(*[F.min(F.expr(least(j))).alias(f"s{j}") for j in range(DRAWS)])
    of = lambda i: F.array(*[code(F.col(f"s{i}_{j}")).cast("int") for j in range(DRAWS)])
    both = found.groupBy(*at, "chunk").agg(*[F.min(F.when(F.col("side").isin(i, 2), F.col(f"s{j}"))).alias(f"s{i}_{j}") for i in (0, 1) for j in range(DRAWS)])
    both = both.select(*at, F.when(F.col("facts").isNull(), F.struct("chunk", of(0).alias("own"), of(1).alias("edited"))).alias("c"))
    whole = both.groupBy("stretch", "at").agg(F.max("facts").alias("facts"), F.sort_array(F.collect_list("c")).alias("c"))
    whole = whole.select("stretch", "at", "facts.*", *[F.flatten(F.col("c").getField(c)).alias(c) for c in ("own", "edited")])
    near = whole.withColumn("then", F.lead("own").over(Window.partitionBy("stretch").orderBy("at"))).filter(F.col("sha").isNotNull())
    return near.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), hexed(F.col("own")).alias("fingerprint"), hexed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("then")).alias("near_next"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of fingerprints over documents, whose ids are distinct."""
    maps = [dealt(i) for i in range(2)]
    chunks = ", ".join(f"({c}, {', '.join(str(m[k][c]) for m in maps for k in range(3))})" for c in range(CHUNKS))
    draws = ", ".join(f"({j}, {', '.join(str(n) for i in range(3) for n in factors(f'draw {j} {i}'))})" for j in range(DRAWS))
    names = ", ".join(f"a{i}, b{i}, c{i}" for i in range(3))
    v = ", ".join(f"{hashed(f'a{i}', f'b{i}', f'c{i}', 'p', 'q')} AS v{i}" for i in range(3))
    u = ", ".join(f"{x.replace('D)', '::DOUBLE)').replace('D / ', '::DOUBLE / ').replace('0.5D', '0.5::DOUBLE')} AS u{i}" for i, x in enumerate(UNIFORM))
    sql = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS at, count(*) OVER () AS total FROM documents),
e AS (SELECT d.doc_id, d.t, n.doc_id AS next_id, length(d.t) AS n_chars, substr(d.t, 1, length(d.t) - length(d.t) // 2) || substr(n.t, 1, length(d.t) // 2) AS edited
  FROM d JOIN d n ON n.at = d.at % d.total + 1),
sides AS (SELECT doc_id, 0 AS side, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
words AS (SELECT doc_id, side, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS word FROM sides),
terms AS (SELECT doc_id, side, ln(count(*)::DOUBLE) AS log_w, md5(word) AS h FROM words GROUP BY doc_id, side, word),
numbers AS (SELECT doc_id, side, log_w, ('0x' || substr(h, 1, 7))::BIGINT AS x, ('0x' || substr(h, 8, 7))::BIGINT AS y, ('0x' || substr(h, 15, 7))::BIGINT AS z FROM terms),
chunks(chunk, pa, pb, pc, qa, qb, qc) AS (VALUES {chunks}),
draws(j, {names}) AS (VALUES {draws}),
chunked AS (SELECT doc_id, side, log_w, z, chunk, {hashed('pa', 'pb', 'pc', 'x', 'y')} AS p, {hashed('qa', 'qb', 'qc', 'x', 'y')} AS q FROM numbers, chunks),
hashes AS (SELECT doc_id, side, log_w, z, {DRAWS} * chunk + j AS k, {v} FROM chunked, draws),
uniform AS (SELECT doc_id, side, k, log_w, z, {u} FROM hashes),
gamma AS (SELECT doc_id, side, k, z, -ln(u0 * u1) AS r, -ln(u2 * u3) AS c, u4 AS b, floor(log_w / (-ln(u0 * u1)) + u4) AS step FROM uniform),
least_of AS (SELECT doc_id, side, k, min(floor((ln(c) - r * (step - b + 1) + 100) * {1 << STEP_BITS})::BIGINT * {1 << BITS} + ((z + 7919 * step::BIGINT) & {(1 << BITS) - 1})) AS s FROM gamma GROUP BY doc_id, side, k),
codes AS (SELECT doc_id, side, list((s & {(1 << BITS) - 1}) % 65535 + 1 ORDER BY k) AS codes FROM least_of GROUP BY doc_id, side),
whole AS (SELECT doc_id, side, coalesce(codes, list_transform(range({SAMPLES}), lambda i: 0::BIGINT)) AS codes FROM sides LEFT JOIN codes USING (doc_id, side)),
near AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, own.codes AS own, edited.codes AS edited, other.codes AS other
  FROM e JOIN whole own ON own.doc_id = e.doc_id AND own.side = 0 JOIN whole edited ON edited.doc_id = e.doc_id AND edited.side = 1 JOIN whole other ON other.doc_id = e.next_id AND other.side = 0)
SELECT doc_id, n_chars, edited_sha256,
  array_to_string(list_transform(own, lambda c: printf('%04x', c)), '') AS fingerprint, array_to_string(list_transform(edited, lambda c: printf('%04x', c)), '') AS edited_fingerprint,
  list_sum(list_transform(list_zip(own, edited), lambda p: (p[1] = p[2])::INT))::DOUBLE / {SAMPLES} AS near_edited,
  list_sum(list_transform(list_zip(own, other), lambda p: (p[1] = p[2])::INT))::DOUBLE / {SAMPLES} AS near_next
FROM near
"""
    return re.sub(r"shiftright\(([^()]*(?:\([^()]*\))?[^(),]*), (\d+)\)", r"((\1) >> \2)", sql)  # DuckDB's way to write it
