from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("whole", [False, True])
def test_targets_and_takings(request, which, whole):
    df = request.getfixturevalue(which)
    rows = mixing.mixed(df, whole=whole).collect()
    assert len(rows) == df.count() and mixing.mixed(df).columns == [*df.columns, "mix"]
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        m = r.mix
        assert m.size == words(r.text) and m.source_size == sizes[r.source] and m.target == pytest.approx(want[r.source])
        assert m.taken <= 2 * m.size and (m.position is None) == (m.taken == 0)
        taken[r.source] += m.taken
    longest = max(r.mix.size for r in rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (longest / 2 if whole else 1)


def test_reruns_and_block_sizes_agree(docs):
    one = sorted(tuple(r) for r in mixing.mixed(docs).select("doc_id", "mix.*").collect())
    assert one == sorted(tuple(r) for r in mixing.mixed(docs.repartition(5)).select("doc_id", "mix.*").collect())
    few = sorted(tuple(r) for r in mixing.mixed(docs, rows_a_block=7).select("doc_id", "mix.*").collect())
    assert [r[:5] for r in few] == [r[:5] for r in one]
    np.testing.assert_allclose([r[6] or -1 for r in few], [r[6] or -1 for r in one])


def test_positions_follow_the_schedule(spark):
    df = spark.createDataFrame([(i, "a b c d", f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mixed(df, weights=(1,), share=1.0).select("source", "mix.position").collect()
    for k, early in enumerate((0.625, 0.5, 0.375)):  # the schedules' integrals up to 1/2
        p = np.array([r.position for r in rows if r.source == f"s{k}"])
        assert (p <= 0.5).mean() == pytest.approx(early, abs=0.01) and 0 <= p.min() and p.max() <= 1


def test_inverting_the_integral(spark):
    knots = mixing.knots_of([((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))], F.lit(1))
    at = [0.0, 0.1, 0.25, 0.5, 0.6, 1.0]
    rows = spark.createDataFrame([(x,) for x in at], "x double").select(mixing.position(F.col("x"), F.lit(1.0), knots).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, [0, 0.25, 0.5, 1], [0, 2, 0, 1])
    cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
    for x, r in zip(at, rows, strict=True):
        assert np.interp(r.t, grid, cum / cum[-1]) == pytest.approx(x, abs=1e-6)


def test_order_and_empty(docs, none):
    p = [r.position for r in mixing.in_training_order(mixing.mixed(docs).select("doc_id", "mix.position"), "position").collect()]
    known = [x for x in p if x is not None]
    assert known == sorted(known) and p[: len(known)] == known
    assert mixing.mixed(none).collect() == []
    with pytest.raises(ValueError):
        mixing.mixed(docs, most=3)
