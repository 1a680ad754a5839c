"""What is registered, and the queries with SQL against it."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from compare import duck, normal
from pyspark.sql import functions as F
from test_dedup import brute
from test_mixing import fill, words
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import queries

SQL = queries.oracle_sql()


def test_one_query_for_each_operator():
    import __spark_entry__

    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    assert normal(queries.queries()[name](spark, small).toPandas()) == normal(duck(small).sql(SQL[name]).df())


def test_pipeline_stages(spark, small, docs):
    from sluice.llm import ngram_join, quality

    kept = corpus_pipeline.rules(spark, docs, small)
    verdict = quality.quality_rules(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in verdict.filter("kept").collect())
    once = corpus_pipeline.exact(spark, kept, small)
    texts = [r.text for r in once.collect()]
    assert len(texts) == len(set(texts)) == len({r.text for r in kept.collect()})
    apart = corpus_pipeline.near(spark, once, small)
    assert all(r.group_size == 1 for r in ngram_join.jaccard_join(apart).collect())
    assert {r.class_id for r in ngram_join.jaccard_join(once).collect()} == {r.doc_id for r in apart.collect()}
    mixed = corpus_pipeline.mix(spark, apart, small)
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in apart.collect()}
    for frame in (kept, once, apart, mixed):
        assert frame.schema.names == docs.schema.names
    whole = corpus_pipeline.run(spark, small).groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in whole)


def mixed_by_hand(spark, rows):
    """How often the mix takes each of rows, whole: the sources' targets filled in the order of the seed, twice at most."""
    ids = spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long")
    key = {r.doc_id: r.key for r in ids.select("doc_id", F.xxhash64(F.lit(17), F.col("doc_id").cast("string")).alias("key")).collect()}
    assert len(key) == len(rows)
    sizes, times, at = {}, Counter(), Counter()
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    target = fill(sizes)
    order = sorted(rows, key=lambda r: (key[r.doc_id] % 2**64 >> 44, key[r.doc_id]))
    for r in order + order:
        n = words(r.text)
        if n and 2 * at[r.source] + n <= 2 * target[r.source]:
            times[r] += 1
        at[r.source] += n
    return times


def test_pipeline_stages_by_hand(spark, small, docs):
    kept = corpus_pipeline.rules(spark, docs, small).cache()
    rows = kept.collect()
    assert rows and not Counter(rows) - Counter(docs.collect())
    last = {}
    for r in rows:
        last[r.text] = max(last.get(r.text, r), r, key=lambda x: x.doc_id)
    once = corpus_pipeline.exact(spark, kept, small).cache()
    assert Counter(once.collect()) == Counter(last.values())
    low = {x[1] for x in brute(once.collect())}
    apart = corpus_pipeline.near(spark, once, small).cache()
    assert Counter(apart.collect()) == Counter(r for r in last.values() if r.doc_id in low)
    times = mixed_by_hand(spark, apart.collect())
    assert Counter(corpus_pipeline.mix(spark, apart, small).collect()) == times and max(times.values()) == 2
    t, covered = Tokenizer.from_file(queries.VOCAB), {}
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in times}
    for r in corpus_pipeline.run(spark, small).collect():
        x, part = ids[r.doc_id], slice(r.start, r.start + r.length)
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[part].tobytes())
        covered.setdefault(r.doc_id, np.zeros(len(x), int))[part] += 1
    assert {i: set(n) for i, n in covered.items()} == {r.doc_id: {n} for r, n in times.items()}


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_take_odd_and_empty_tables(spark, small, request, which):
    df = request.getfixturevalue(which).withColumn("mix", F.lit("own")).withColumn("position", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, small)
        rows = out.collect()
        if name != "packing":
            assert out.columns == df.columns and all((r.mix, r.position) == ("own", "mine") for r in rows)
            assert not set(rows) - set(df.collect())
        assert bool(rows) == (which == "odd") or name == "quality rules"


def test_the_rest_works_without_what_the_part_needs(tmp_path):
    """With a library of the part missing, the other queries are still there."""
    import os
    import subprocess
    import sys

    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{os.environ['PYTHONPATH']}"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=os.path.dirname(corpus_pipeline.__file__), capture_output=True, text=True, timeout=60).stdout.split()
    assert int(out[0]) > 90 and out[1:] == ["False", "True"]
