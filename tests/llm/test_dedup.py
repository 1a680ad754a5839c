"""Exact, line and near dedup, licences and token counts against brute force."""

from __future__ import annotations

import hashlib
import inspect
import itertools
import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import exact_dedup, licences, line_dedup, ngram_join, token_counts
from sluice.llm.queries import END_OF_TEXT, VOCAB


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_exact(request, which):
    df = request.getfixturevalue(which)
    rows = df.collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.text or "", []).append(-1 if r.doc_id is None else r.doc_id)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(rows) and Counter(r.text_sha256 for r in got) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in ids.items()}
    for r in got:
        assert (-1 if r.keep_id is None else r.keep_id, r.group_size) == (max(by[r.text_sha256]), len(by[r.text_sha256]))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(by, 1))
    kept = exact_dedup.drop_copies(df).collect()
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept) == sorted((t, max(v)) for t, v in ids.items())
    assert exact_dedup.drop_copies(df).columns == df.columns


def test_no_rows(none):
    assert exact_dedup.exact_dedup(none).collect() == [] and exact_dedup.drop_copies(none).collect() == []
    assert line_dedup.dedup_lines(none).collect() == []


def test_exact_with_a_crowded_filter(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows, per_row=16: 4)
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == docs.select("text").distinct().count()
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == docs.select("text").distinct().count()


def test_exact_in_ranges_and_stretches(spark, docs, odd, monkeypatch):
    whole = {which: (sorted(map(str, exact_dedup.exact_dedup(df).collect())), sorted(map(str, exact_dedup.drop_copies(df).collect()))) for which, df in (("docs", docs), ("odd", odd))}
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 4096)
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows, per_row=16: 18)  # 32 KB, so eight ranges
    bounds = []
    tested = exact_dedup.tested
    monkeypatch.setattr(exact_dedup, "tested", lambda digests, bloom, bits: bounds.append(bits) or tested(digests, bloom, bits))
    for which, df in (("docs", docs), ("odd", odd.repartition(5, "doc_id"))):
        got = exact_dedup.exact_dedup(df)
        assert sorted(map(str, got.collect())) == whole[which][0]
        assert sorted(map(str, exact_dedup.drop_copies(df).collect())) == whole[which][1]
    assert bounds == [15] * 32


def test_bitmaps_are_cut_by_number(spark):
    gone = spark.range(0, 40 * 32_768, 999).select(F.expr("id div 32768").alias("b"), F.expr("id % 32768").alias("bit")).groupBy("b").agg(F.expr("bitmap_construct_agg(bit)").alias("m"))
    assert exact_dedup.cuts(gone, 40) == [] and exact_dedup.cuts(gone, 7) == [7, 14, 21, 28, 35]


def test_dropping_copies_shuffles_no_text(spark, docs, monkeypatch):
    plan = exact_dedup.drop_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("joined", ["auto", "sorted"])
@pytest.mark.parametrize(("which", "enough", "least"), [("docs", 10, 1), ("odd", 2, 1), ("docs", 3, 20)])
def test_lines(request, spark, which, enough, least, joined):
    if joined == "sorted":  # as where there are too many frequent lines or documents to broadcast
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            before = spark.conf.get(name, None)
            spark.conf.set(name, "-1")
            request.addfinalizer(lambda n=name, v=before: spark.conf.unset(n) if v is None else spark.conf.set(n, v))
    df = request.getfixturevalue(which)
    rows = df.collect()
    held = Counter(k for r in rows for k in {key(x) for x in (r.text or "").split("\n")} if len(k) >= least)
    want = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or held[key(x)] < enough]
        want[r.doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    out = line_dedup.dedup_lines(df, enough, least)
    assert Counter((r.doc_id, *r.lines) for r in out.collect()) == want
    assert out.columns == [*df.columns, "lines"]


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, enough=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([x]), 1) for x in range(b, 5)], "line binary, n_docs long"))
    assert [len(x) for x in runs.counted] == [1, 0, 1] == [len(x) for x in runs.known]
    assert sorted(bytes(r.line)[0] for r in runs.frequent().collect()) == [2, 3, 4]
    runs.close()


def test_stored_runs_are_neither_shuffled_nor_sorted(spark):
    runs = line_dedup.LineRuns(spark, enough=3, fanout=9)
    batch = spark.range(500).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("line"), F.lit(2).cast("long").alias("n_docs"))
    runs.add(batch)
    runs.add(batch)
    with line_dedup.sorted_buckets(spark):
        merge = runs.merged(*runs.counted[0])._jdf.queryExecution().executedPlan().toString()
        anti = runs.unknown(batch)._jdf.queryExecution().executedPlan().toString()
        reached = runs.reached(runs.counted[0][-1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merge and "Exchange" not in merge and "Sort [" not in merge
    # the batch alone is dealt and sorted, once
    assert anti.count("SortMergeJoin") == 2 and anti.count("Exchange") == 1 and anti.count("Sort [") == 1
    assert reached.count("SortMergeJoin") == 1 and "Exchange" not in reached and "Sort [" not in reached
    assert runs.frequent().count() == 500
    runs.close()


def dropped(out):
    return sorted((r.doc_id, r.lines.n_dropped) for r in out.collect())


def test_a_repeated_call_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"Menu\nin five {i % 6}\nown {i}") for i in range(30)], "doc_id long, text string")
    store = f"file://{tmp_path}/store"
    first = dropped(line_dedup.dedup_lines(df, store=store))
    assert first == [(i, 1) for i in range(30)]
    assert dropped(line_dedup.dedup_lines(df, store=store)) == first
    assert dropped(line_dedup.dedup_lines(df.repartition(3), store=store)) == first
    assert dropped(line_dedup.dedup_lines(df, store=store, call="again")) == [(i, 2) for i in range(30)]


def test_a_call_that_fails_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store, add, times = f"file://{tmp_path}/store", line_dedup.LineRuns.add, []
    before = spark.createDataFrame([(i, f"Menu\nold {i % 2}") for i in range(8)], "doc_id long, text string")
    line_dedup.dedup_lines(before, store=store)
    names = lambda: sorted(x.name for x in (tmp_path / "store").iterdir())
    held = names()

    def failing(self, batch):
        times.append(1)
        if len(times) == 3:
            raise RuntimeError("lost")
        add(self, batch)

    df = spark.createDataFrame([(i, "Menu\nnew") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(line_dedup.LineRuns, "add", failing)
    with pytest.raises(RuntimeError):
        line_dedup.dedup_lines(df, store=store)
    assert names() == held
    assert dropped(line_dedup.dedup_lines(df, store=store)) == [(i, 1) for i in range(9)]


def test_buckets_double_as_a_store_grows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(line_dedup, "BUCKET_LINES", 5)
    df = spark.createDataFrame([(i, f"Menu\nown {i}") for i in range(100)], "doc_id long, text string")
    store = f"file://{tmp_path}/store"
    assert dropped(line_dedup.dedup_lines(df, store=store)) == [(i, 1) for i in range(100)]
    runs = line_dedup.LineRuns(spark, 10, path=store)
    assert runs.lines > 5 and runs.lines <= 5 * runs.buckets < 4 * runs.lines + 5 * 8
    assert len(runs.calls) == 1
    runs.close()
    assert dropped(line_dedup.dedup_lines(df.limit(3), store=store, call="more")) == [(i, 1) for i in range(3)]


def test_lines_of_odd_rows_match_the_sql(spark):
    rows = [(1, "Menu\nown")] * 10 + [(None, "Home \n\nx")] * 12 + [(2, None), (2, ""), (3, "menu"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(line_dedup.ORACLE_SQL).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(r[2] for r in want) > 20


STORE = r"""
import sys
from pyspark.sql import SparkSession
from sluice.llm import line_dedup
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").getOrCreate()
df = spark.createDataFrame([(int(sys.argv[2]), "Menu\nhome\nown " + sys.argv[2])], "doc_id long, text string")
r = line_dedup.dedup_lines(df, enough=2, batches=2, store="file://" + sys.argv[1] + "/store").first().lines
print("GOT", r.n_lines, r.n_dropped, r.kept.split("\n"))
"""


def test_a_second_process_meets_the_first_ones_lines(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = []
    for i in range(3):
        done = subprocess.run([sys.executable, "-c", STORE, str(tmp_path), str(i)], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]
        got.append(next(x for x in done.stdout.splitlines() if x.startswith("GOT")))
    assert got == ["GOT 3 0 ['Menu', 'home', 'own 0']", "GOT 3 2 ['own 1']", "GOT 3 2 ['own 2']"]


def shingles(text):
    w = [x for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(r.text) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            parent[find(j)] = find(i)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r.doc_id)
    return Counter((r.doc_id, min((x for x in low[find(i)] if x is not None), default=None), links[i], len(low[find(i)])) for i, r in enumerate(rows))


def near_copies(spark):
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, common, bases = [], word(30), [word(int(n)) for n in rng.integers(20, 400, 12)]
    for i in range(400):
        w = list(bases[0] if i % 3 == 0 else bases[rng.integers(12)])
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(len(w))] = f"new{rng.integers(10**6)}"
        rows.append((i, " ".join(w + common * (i % 5 == 0))))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_join_is_brute_force(spark, docs, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    for df in (near_copies(spark), odd) if block < 512 else (near_copies(spark), docs, odd):
        assert Counter(tuple(r) for r in ngram_join.jaccard_join(df).collect()) == brute(df.collect())


def test_one_of_each_group_stays(spark, odd, none):
    df = near_copies(spark)
    assert {r.doc_id for r in ngram_join.keep_one(df).collect()} == {r.class_id for r in ngram_join.jaccard_join(df).collect()}
    assert ngram_join.keep_one(odd).columns == odd.columns
    assert {r.doc_id for r in ngram_join.keep_one(odd).collect()} == {1, 3, None, 4, 5, 6, 7, 8}
    assert ngram_join.jaccard_join(none).collect() == [] and ngram_join.keep_one(none).collect() == []


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for lo, hi in ((0, 41), (100, 160), (200, 209)):
        assert len({got[i] for i in range(lo, hi)}) == 1
    assert len(set(got.values())) == 3


def test_pruning_keeps_likely_pairs():
    need = ngram_join.least_matches(0.8, 1e-6)
    assert need[0] == 0 and need[8] <= 2 and 50 <= need[96] <= 62
    rng = np.random.default_rng(0)
    kept = (rng.binomial(96, 0.8, 100_000) >= need[96]).mean()
    assert kept > 0.9999 and (rng.binomial(96, 0.4, 10_000) >= need[96]).mean() < 0.01


@pytest.mark.parametrize("run", [ngram_join.jaccard_join, ngram_join.keep_one])
def test_pruning_loses_few_pairs_over_all_its_steps(run):
    need = ngram_join.least_matches(0.8, inspect.signature(run).parameters["tolerance"].default)
    step = [math.comb(ngram_join.LANES, k) * 0.8**k * 0.2 ** (ngram_join.LANES - k) for k in range(ngram_join.LANES + 1)]
    left, lost = np.array([1.0]), 0.0  # left[m]: the share of pairs still there with m matches
    for w in range(1, ngram_join.BANDS + 1):
        left = np.convolve(left, step)
        lost += left[: need[ngram_join.LANES * w]].sum()
        left[: need[ngram_join.LANES * w]] = 0
    assert left.sum() + lost == pytest.approx(1) and lost < 1e-7


def windows_brute(rows, templates, contained=0.8):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for r in rows:
        s = grams(words(r.text))
        for name, t in templates:
            want = set(grams(words(t)))
            if want and any(len(set(s[i : i + len(want)]) & want) >= contained * len(want) for i in range(max(1, len(s)))):
                out.add((r.doc_id, name))
    return out


def test_licences(spark, docs):
    rng = np.random.default_rng(0)
    extra = []
    for i, (_, t) in enumerate(licences.TEMPLATES * 3):
        w = t.split()
        noise = [f"n{x}" for x in rng.integers(0, 999, 60)]
        if i >= len(licences.TEMPLATES) and len(w) > 40:
            w[len(w) // 2] = "changed"
        extra.append((10_000 + i, " ".join(noise[: rng.integers(0, 60)] + w + noise)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = licences.scan(df).collect()
    want = windows_brute(df.collect(), licences.TEMPLATES)
    assert {(r.doc_id, r.template) for r in got} >= want and len(got) == len({(r.doc_id, r.template) for r in got})
    for r in got:
        assert 0.8 <= r.containment <= 1 and r.first_word < r.last_word


def test_licences_of_odd_rows(odd, none):
    assert licences.scan(odd).collect() == [] and licences.scan(none).collect() == []
    assert licences.scan(odd, [("short", "two words")]).collect() == []
    two = licences.scan(odd, [("greek", "Alpha, beta: gamma delta epsilon ZETA")]).collect()
    assert sorted((r.doc_id, r.containment, r.first_word, r.last_word) for r in two) == [(1, 1.0, 0, 6), (2, 1.0, 0, 6), (2, 1.0, 0, 6)] or all(r.containment == 1.0 for r in two) and len(two) == 3


def test_token_counts(docs, odd, none):
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    for df in (docs, odd):
        want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert Counter(tuple(r) for r in token_counts.document_tokens(df, VOCAB, END_OF_TEXT).collect()) == want
    assert token_counts.document_tokens(none, VOCAB, END_OF_TEXT).collect() == []


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_separators_across_blocks(spark, tmp_path, block, dtype):
    rng, want = np.random.default_rng(0), []
    for k, n in enumerate((0, 1, 7, 500, 2001)):
        x = rng.integers(0, 4, n).astype(dtype)
        (tmp_path / f"{k}.bin").write_bytes(x.tobytes() + b"z" * (k == 3))
        start = ordinal = 0
        for i in np.flatnonzero(x == 3):
            want.append((f"{k}.bin", ordinal, start, i - start, True))
            start, ordinal = i + 1, ordinal + 1
        if start < n:
            want.append((f"{k}.bin", ordinal, start, n - start, False))
    files = token_counts.files_in(spark, f"file://{tmp_path}")
    got = token_counts.count_tokens(files.union(files), 3, dtype, block).collect()
    assert sorted((r.file.rpartition("/")[2], *r[1:]) for r in got) == sorted(want)


def test_ids_that_do_not_fit_are_an_error(docs):
    with pytest.raises(ValueError, match="doesn't fit"):
        token_counts.write_token_files(docs, "file:///nowhere", VOCAB, 70_000)
    with pytest.raises(Exception, match="doesn't fit"):
        token_counts.write_token_files(docs, token_counts.scratch_path(docs.sparkSession, "small"), VOCAB, 1, dtype="<u1")


def test_texts_without_shingles_do_not_meet_in_a_join(odd):
    plan = ngram_join.jaccard_join(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "isnotnull(digest" in plan.replace("Digest", "digest")
