"""Fingerprints, spelling variants and hard negatives, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import hard_negatives, spelling, weighted_sampling


def test_fingerprints_of_odd_rows(spark, odd):
    rows = odd.collect()
    out = weighted_sampling.fingerprints(odd).collect()
    assert len(out) == len(rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, -(rows[i].doc_id or 0), i))
    texts = [rows[i].text or "" for i in order]
    want = Counter()
    for k, text in enumerate(texts):
        then, half = texts[(k + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - half] + then[:half]
        want[rows[order[k]].doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    size = 4 * weighted_sampling.SAMPLES
    same = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, size, 4)) / weighted_sampling.SAMPLES
    assert all(len(r.fingerprint) == size and r.near_edited == same(r.fingerprint, r.edited_fingerprint) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * size
    assert by[5].near_next == 1.0 and by[2].near_next in (0.0, 1.0) and by[6].near_next == 0.0


def test_no_documents_one_document(spark, none, odd):
    assert weighted_sampling.fingerprints(none).count() == 0
    (r,) = weighted_sampling.fingerprints(odd.filter("doc_id = 1")).collect()
    assert r.near_next == 1.0 and r.n_chars == 35


def test_collision_rate_is_generalised_jaccard(spark):
    rng, rows, want = random.Random(3), [], []
    for i in range(60):
        bags = [Counter({f"w{i}_{k}": rng.choice([0, 1, 1, 2, 5, 30]) for k in range(40)}) for _ in range(2)]
        rows += [(2 * i + j, " ".join(bags[1 - j].elements())) for j in range(2)]
        want.append(sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values()))
    got = {r.doc_id: r.near_next for r in weighted_sampling.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    error = np.array([got[2 * i + 1] - w for i, w in enumerate(want)])
    assert abs(error.mean()) < 0.03 and error.std() < 2 * math.sqrt(0.25 / weighted_sampling.SAMPLES)


def test_fingerprints_shuffle_the_texts_once(spark, docs):
    plan = weighted_sampling.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_no_flags_are_handed_on_with_what_is_drawn(spark, docs):
    """The JVM compiles methods of the plan fully only if they hand on few enough arguments."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # such a plan holds no code before it runs
    try:
        plan = weighted_sampling.fingerprints(docs)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    made = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    most = max(len(x.split(",")) for x in re.findall(r"private void \w*doConsume\w*\(([^)]*)\)", made))
    assert 20 <= most < 30


def test_words_that_are_left_out_have_greater_values(spark):
    weights = "element_at(array(1D, 1D, 2D, 5D), cast(1 + id % 4 as int))"
    hashes = [f"cast(rand({3 * j + i}) * {1 << weighted_sampling.BITS} as long) AS v{j}_{i}" for j in range(weighted_sampling.DRAWS) for i in range(3)]
    rows = spark.range(20_000).selectExpr("id AS z", f"{weights} AS weight", f"ln({weights}) AS log_w", *hashes)
    kept = [f"({weighted_sampling.least(j)}) AS s{j}" for j in range(weighted_sampling.DRAWS)]
    for share in (0.5, 0.1, 0.01):
        every, some = (rows.selectExpr("*", f"{b} * weight AS bound").selectExpr("weight", *kept).collect() for b in ("1e9D", f"{share}D"))
        once, loose = 0, 0
        for a, b in zip(every, some, strict=True):
            for j in range(weighted_sampling.DRAWS):
                value = math.exp((a[f"s{j}"] >> weighted_sampling.BITS) / (1 << weighted_sampling.STEP_BITS) - 100)
                assert b[f"s{j}"] == a[f"s{j}"] if b[f"s{j}"] is not None else value > share * (1 - 1e-6)
                if a.weight == 1 and b[f"s{j}"] is not None:
                    once, loose = once + 1, loose + (value > share)
        assert once and loose < 0.72 * once


def edits(w: str, alphabet: str) -> set[str]:
    n = len(w)
    return {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + c + w[i + 1 :] for i in range(n) for c in alphabet if c != w[i]} | {w[:i] + c + w[i:] for i in range(n + 1) for c in alphabet}


@settings(max_examples=60, deadline=None)
@given(st.text("abcé", max_size=9), st.integers(1, 400))
def test_neighbourhood_is_all_distinct_edits(word, at_once):
    before, spelling.AT_ONCE = spelling.AT_ONCE, at_once
    try:
        made = [(spelling.edited(word, p, c, k), h) for hs, ps, cs, k in spelling.neighbourhood(word, np.array(sorted(map(ord, "abcé")), np.uint64)) for h, p, c in zip(hs.tolist(), ps.tolist(), cs.tolist(), strict=True)]
    finally:
        spelling.AT_ONCE = before
    assert len(made) == len({w for w, _ in made}) and {w for w, _ in made} == edits(word, "abcé")
    assert [h for _, h in made] == spelling.hash_of([w for w, _ in made]).tolist()


def variants_by_hand(rows) -> set[tuple]:
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = "".join(sorted({c for w in n for c in w}))
    near = {w: {v for v in edits(w, letters) if v in n and v != w} for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def test_variants_by_hand(spark):
    rng = random.Random(5)
    stems = ["colour", "color", "Ünïcödé", "banana", "bananas", "bannana", "xxxxxx", "xxxxxxx", "ÀÉÎõü", "letters"]
    rows = [(None if i % 17 == 0 else i // 2, None if i % 23 == 0 else " ".join(rng.choice(stems[: 3 + i % 8]) + rng.choice(["", "", "s", "1", "é"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(800, "chained " * 3 + "chaineds " * 8 + "chainedst " * 20)]
    rows += [(900, "q" * 400 + " " + "q" * 399 + "r")] * 3
    out = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = variants_by_hand(rows)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == want and len(out) == len(want)
    assert any(w[1] and w[1] != w[2] for w in want)


def test_variants_of_odd_and_empty_tables(spark, odd, none):
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(odd).collect()}
    assert got == variants_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling.variants(none).count() == 0


def test_variants_broadcast_no_table(spark, docs, monkeypatch):
    """However small Spark takes it for: candidates are many a word, which the size of a vocabulary's files doesn't tell."""
    plans, write = [], spelling.materialize

    def planned(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, *rest)

    monkeypatch.setattr(spelling, "materialize", planned)
    out = spelling.variants(docs)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {"vocabulary", "forms", "hops", "out"} == {name for name, _ in plans} and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert not [name for name, plan in plans if "BroadcastExchange" in plan]
    assert [name for name, plan in plans if "SortMergeJoin" in plan][0] == "forms"


def negatives_by_hand(rows, queries) -> Counter:
    part = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    out = Counter()
    for a in {i for i, _, _ in part if queries(i)}:
        label, vector = min((y, v) for i, y, v in part if i == a)
        own = sorted((-score(vector, v), i) for i, y, v in part if i != a and y == label)[:5]
        for s, p in own:
            found = sorted((-n, i) for i, y, v in part if y != label and 50 * -s <= 100 * (n := score(vector, v)) <= 95 * -s)[:3]
            for rank, (n, i) in enumerate(found, 1):
                out[a, p, rank, i, -s, -n] += 1
    return out


@pytest.mark.parametrize("spread", [1, 40])
def test_negatives_by_hand(spark, monkeypatch, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (6, 5))
    rows = [(i, int(k), [float(x) for x in centres[(k + (i % 3 == 0)) % 6] * 3 + rng.integers(-3, 4, 5)]) for i, k in enumerate(rng.integers(0, 4, 900))]
    rows += [(50, 1, [1.0, 2.0, 3.0, 4.0, 5.0]), (7, 2, [9.0] * 5), (7, 2, [9.0] * 5)]  # repeated ids
    rows += [(None, 1, [1.0] * 5), (1000, None, [1.0] * 5), (1050, 1, None), (1100, 1, [float("nan")] * 5), (1150, 2, [None, 1.0]), (1200, 2, []), (1250, 3, [30.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")
    monkeypatch.setattr(hard_negatives, "QUERIES", 7)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    got = Counter(tuple(r) for r in hard_negatives.mine(df, df.vec_id % 50 == 0).collect())
    assert got == negatives_by_hand(rows, lambda i: i % 50 == 0) and got


def test_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, vector array<double>")
    assert hard_negatives.mine(df, df.vec_id % 50 == 0).count() == 0


def test_brackets_hold_the_score():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-200, 200, (300, 8)).astype(float), rng.integers(-200, 200, (20, 8)).astype(float)
    longest = (x * x).sum(axis=1).max()
    pivots = hard_negatives.choose_pivots(hard_negatives.augmented(x, longest))
    low, high = hard_negatives.brackets(hard_negatives.distances(np.c_[q, np.zeros(20)], pivots), hard_negatives.distances(hard_negatives.augmented(x, longest), pivots), (q * q).sum(axis=1), longest)
    assert ((low <= q @ x.T) & (q @ x.T <= high)).all() and (high < np.abs(q).sum(axis=1).max() * 200).any()
