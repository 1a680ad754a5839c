"""Language, quality and toxicity: brute force for what is exact, held-out accuracy for what is learned."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import language, quality, toxicity
from sluice.llm.common import least_hash, sampled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, repeat = len(words), len(again)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeat, n < 50 or 100 * repeat > 50 * n


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_statistics(request, labels, which):
    df = request.getfixturevalue(which)
    got = Counter((r.doc_id, *r[1:7]) for r in quality.quality_rules(df, labels).collect())
    assert got == Counter((r.doc_id, *base(r.text)) for r in df.collect())


def test_repeats_with_a_large_vocabulary():
    codes = np.random.default_rng(1).integers(0, 4, 500) + (1 << 22)
    grams = Counter(zip(codes, codes[1:], codes[2:], strict=False))
    want = {i + k for i in range(498) if grams[tuple(codes[i : i + 3])] > 1 for k in range(3)}
    assert quality.repeat_words(codes) == quality.repeat_words(codes - (1 << 22)) == len(want)


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    d = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_rules(df, labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    kept = quality.keep_good(df, labels)
    assert kept.schema == df.schema and kept.count() == quality.quality_rules(df, labels).filter("kept").count()


def test_forest_gives_short_paths_to_strangers():
    x = np.random.default_rng(0).normal(size=(1000, 3))
    f = quality.Forest.fit(x, 100, 256, 12, 0)
    assert f.score(np.full((1, 3), 6.0))[0] > np.quantile(f.score(x), 0.99)


def test_without_labels(docs, odd, none, spark, labels):
    nothing = labels.limit(0)
    assert all(r.kept != r.base_failed for r in quality.quality_rules(docs, nothing).collect())
    assert quality.quality_rules(none, labels).collect() == [] and quality.keep_good(none, labels).collect() == []
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert all(r.score == 0 and r.predicted == 0 for r in toxicity.toxicity(odd, nothing).collect())
    assert toxicity.toxicity(none, labels).collect() == [] and language.language(none).collect() == []


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.97


def test_language_of_odd_texts(odd):
    rows = language.language(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0)


def test_false_positives_are_taken_off():
    rng = np.random.default_rng(0)
    keys = {x: rng.integers(0, 2**63, 5000).astype(np.uint64) for x in ("aa", "bb")}
    f = language.Filters.build(keys, slots_a_key=2)
    strange = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (f.false > 0.05).all() and f.counts(strange, np.array([len(strange)])).max() < 0.02
    assert f.counts(keys["aa"], np.array([5000]))[0, 0] == pytest.approx(1)


def test_more_than_64_languages():
    rng = np.random.default_rng(0)
    keys = {f"l{i:03}": rng.integers(0, 2**63, 100).astype(np.uint64) for i in range(70)}
    f = language.Filters.build(keys)
    for i in (0, 63, 64, 69):
        assert f.counts(keys[f"l{i:03}"], np.array([100])).argmax() == i


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(df, labels).join(labels, "doc_id").collect()
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    caught, alarms = np.mean([r.predicted for r in held if r.toxic]), np.mean([r.predicted for r in held if not r.toxic])
    # some 300 toxic documents are learned from at this size; with ten times as many, more than 0.9 are caught
    assert caught > 0.6 and alarms < 0.03


def test_toxicity_of_odd_texts(odd, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[1] == score[2] and score[3] == score[4] == score[5] and texts[1] == texts[2]
    assert len({r.score for r in rows if r.doc_id == 2}) == 1


def test_windows_are_laid_out_once_for_both_dictionaries(monkeypatch):
    made, laid = [], toxicity.zstandard.BufferWithSegments
    monkeypatch.setattr(toxicity.zstandard, "BufferWithSegments", lambda *x: made.append(x) or laid(*x))
    monkeypatch.setattr(toxicity, "AT_ONCE", 10)
    distances = toxicity.Distances(toxicity.Dictionaries(b"some ordinary words of a text", b"quite other ones"))
    of, n = distances.of([b" some other words and quite ordinary ones of a longer text that has more than ten windows ", b"", b" a "])
    assert n.sum() == len(of) > 10 and len(made) == -(-len(of) // 10)


def test_of_equal_windows_one_is_compressed(monkeypatch):
    made, laid = [], toxicity.zstandard.BufferWithSegments
    monkeypatch.setattr(toxicity.zstandard, "BufferWithSegments", lambda *x: made.append(len(x[1]) // 16) or laid(*x))
    both = toxicity.Dictionaries(b"some ordinary words of a text", b"quite other ones")
    distances = toxicity.Distances(both)
    # the last is short, and with what follows it in the text or with the carrier it looks like a whole one
    texts = [b" some other words and quite ordinary ones of a text ", b" quite other ", b" x abcdefghij 0123456789 ", b" abcdefghij 0123456789 ", b" abcd ", b" abcd ", b" abcd ", b" ab"]
    texts = [*texts, b"", *texts, *texts[:2] * 3]
    own = [[t[i : i + 16] for i in toxicity.places(t)] for t in texts]
    one, two = (toxicity.compressor(x) for x in (both.ordinary, both.ordinary + both.toxic))
    want = [len(one.compress(w + toxicity.CARRIER)) - len(two.compress(w + toxicity.CARRIER)) for x in own for w in x]
    kinds = {w for x in own for w in x}
    got, n = distances.of(texts)
    assert got.tolist() == want and n.tolist() == [len(x) for x in own]
    # a short window may be kept once for each that follows it
    assert len(kinds) <= sum(made) < len(want) / 2
    # the bounds only decide which windows are compared, and a collision of hashes changes nothing
    for name, x in (("AMONG", 1), ("AMONG", 7), ("SPREAD", (np.uint64(0),) * 2)):
        monkeypatch.setattr(toxicity, name, x)
        assert distances.of(texts)[0].tolist() == want
    batches = [toxicity.pa.RecordBatch.from_pydict({"doc_id": [i, None], "text": ["some text", None]}) for i in range(5)]
    for most in (1, 100, 10**6):
        monkeypatch.setattr(toxicity, "TOGETHER", most)
        assert [r for b in toxicity.together(iter(batches)) for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert list(toxicity.together(iter([]))) == []


def test_windows_and_distances_are_those_of_whole_compressions(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    texts = [[toxicity.folded(r.text.encode()) for r in rows if r.toxic == y] for y in (0, 1)]
    made = toxicity.Dictionaries.train(*texts)
    assert made.ordinary and made.toxic
    distances = toxicity.Distances(made)
    monkeypatch.setattr(toxicity, "AT_ONCE", 37)
    for text in [*texts[1][:3], *texts[0][:3], b" ab ", b" x" * 9 + b" "]:
        whole = [text[i : i + 16] for i in range(0, max(1, len(text) - 10), 6)]
        assert [text[i : i + 16] for i in toxicity.places(text)] == whole and set(range(len(text))) <= {6 * k + j for k in range(len(whole)) for j in range(16)}
        one, both = toxicity.compressor(made.ordinary), toxicity.compressor(made.ordinary + made.toxic)
        want = []
        for w in whole:
            n, m = len(one.compress(w + toxicity.CARRIER)), len(both.compress(w + toxicity.CARRIER))
            want.append(n - m)
        assert distances.of([b"", text])[0].tolist() == want
        x = distances.features([text])[0]
        assert x[:9] == pytest.approx([np.mean([v >= k for v in want]) ** 0.5 for k in range(1, 10)])
        assert x[9:] == pytest.approx([np.mean(sorted(want)[-3:]), np.mean(want), np.log(len(want))])
    assert distances.of([b""])[0].tolist() == [] and distances.features([None, b"", b" .,! "]).any() == False  # noqa: E712


def test_dictionaries_are_pieces_of_the_samples():
    rng = np.random.default_rng(2)
    samples = [bytes(rng.choice(list(b"abcdefgh "), 64).astype(np.uint8)) for _ in range(2000)]
    whole, made = b"|".join(samples), toxicity.trained(samples, 4_096, 12, 8)
    assert toxicity.MAGIC not in made and 3_000 < len(made) <= 4_096 and all(made[i : i + 8] in whole or any(made[i : i + k] in whole and made[i + k : i + 8] in whole for k in range(1, 8)) for i in range(len(made) - 8))
    few = [b"only three", b"texts", b"of some length"]
    assert toxicity.trained(few, 4_096, 12, 8) == b"only threeof some length" and toxicity.trained([], 4_096, 12, 8) == b""


def test_a_word_of_toxic_text_shortens_its_window():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    text = lambda extra: toxicity.folded(" ".join([*rng.choice(words, 60), *extra, *rng.choice(words, 60)]).encode())
    made = toxicity.Dictionaries.train([text([]) for _ in range(200)], [text(["zqxwvyk"]) for _ in range(100)])
    distances = toxicity.Distances(made)
    assert max(distances.of([text(["zqxwvyk"])])[0]) >= 4 > max(distances.of([text(["unheard"])])[0])


def test_shares_of_samples_in_64_bits(spark):
    ids = spark.range(200_000)
    for share in (0.25, 1e-3):
        n = ids.filter(sampled(share, "id")).count()
        assert abs(n - share * 200_000) < 5 * (share * 200_000) ** 0.5
    assert ids.filter(sampled(1.0, "id")).count() == 200_000
    assert least_hash(2.0**-30) - least_hash(0.0) == 2**34 and ids.filter(sampled(2.0**-50, "id")).count() == 0


def test_language_needs_letters(spark):
    rows = [(i, x, None) for i, x in enumerate(("½", "² ① 5", "Ⅷ", "😀😀😀 😀", "123 !?", "_", None, "", " \n"))] + [(20, "ª", None), (21, "𐐀", None), (22, "漢", None), (23, "½ a", None)]
    rows += [(100 + i, "der die das und nicht ein" if i % 2 else "the and that with for this", "de" if i % 2 else "en") for i in range(60)]
    got = {r.doc_id: r for r in language.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i in range(9):
        assert (got[i].lang_pred, got[i].score) == ("und", 0)
    for i in (20, 21, 22, 23):
        assert got[i].lang_pred == "de" and got[i].score == 0  # no known n-gram: the first language
    assert all(got[100 + i].lang_pred == ("de" if i % 2 else "en") for i in range(60))


def test_decision_is_that_of_the_corrected_counts(spark):
    rng = np.random.default_rng(3)
    keys = {x: rng.integers(0, 2**63, 400).astype(np.uint64) for x in ("aa", "bb", "cc")}
    f = language.Filters.build(keys, slots_a_key=4)
    sizes = np.array([50, 0, 7])
    own = np.concatenate([rng.choice(keys["bb"], 30), rng.integers(0, 2**63, 20).astype(np.uint64), rng.choice(keys["cc"], 7)])
    got = f.counts(own, sizes)
    for row, (lo, hi) in enumerate(((0, 50), (50, 50), (50, 57))):
        for i in range(3):
            hits = sum(all(int(f.slots[at, 0]) >> i & 1 for at in (int(p[0]) for p in f.positions(own[k : k + 1]))) for k in range(lo, hi))
            share = hits / max(1, hi - lo)
            assert got[row, i] == pytest.approx(max(0, (share - f.false[i]) / (1 - f.false[i])))
    assert got[0].argmax() == 1 and got[2].argmax() == 2 and not got[1].any()


def test_n_grams_are_those_of_letters_and_single_spaces():
    texts = ["Straße, ÄRGER!!  ab", "x", "", None, "ab cd 12 ½ef", "𐐀𐐁𐐂𐐃 😀"]
    keys, sizes = language.grams([None if t is None else t.encode() for t in texts])
    at, seen = 0, {}
    for t, n in zip(texts, sizes, strict=True):
        folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t or "")
        padded = " " + " ".join(folded.split()) + " " if folded.split() else " "
        want = [padded[i : i + 4] for i in range(len(padded) - 3)]
        want = [g for g in want if g[1] != " " or g[2] != " "]
        assert n == len(want)
        for g, k in zip(want, keys[at : at + n], strict=True):
            assert seen.setdefault(g, k) == k
        at += n
    assert len(set(seen.values())) == len(seen)


def test_a_sample_of_a_large_corpus_is_not_empty(spark):
    """A share below 2**-20 still takes rows: the sample is drawn by 64-bit hashes."""
    rows = [(None, f"the and that with for this {i}", "en") for i in range(2000)] + [(7, f"der die das und nicht ein {i}", "de") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = language.fit(df, lambda doc_id: F.lit(False), most=200)
    assert f.languages == ["de", "en"] and f.slots.any()
