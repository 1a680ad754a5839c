from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing
from sluice.llm.queries import VOCAB
from sluice.llm.tokens import WordTokens


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_steps_to_neighbours(dims, bits):
    cells = np.array(list(product(range(2**bits), repeat=dims)))
    key = packing.hilbert_key(cells, bits)
    order = np.argsort(key)
    assert sorted(key) == list(range(len(key)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def exact(rows, docs):
    """Each document's pieces hold its own ids, each id once; rows that repeat a doc_id are told apart by their ids."""
    t = Tokenizer.from_file(VOCAB)
    have = {}
    for d in docs:
        have.setdefault(d.doc_id, []).append(np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4"))
    covered = {}
    for r in rows:
        part = slice(r.start, r.start + r.length)
        own = [i for i, x in enumerate(have[r.doc_id]) if len(x) == r.doc_tokens and zlib.crc32(x[part].tobytes()) == r.ids_crc32]
        assert own and r.length > 0
        first = next(i for i, x in enumerate(have[r.doc_id]) if x.tobytes() == have[r.doc_id][own[0]].tobytes())
        covered.setdefault((r.doc_id, first), np.zeros(r.doc_tokens, int))[part] += 1
    for doc_id, own in have.items():
        for i, x in enumerate(own):
            times = sum(x.tobytes() == y.tobytes() for y in own)
            if not any(x.tobytes() == y.tobytes() for y in own[:i]):
                assert (covered[doc_id, i] == times).all()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0


def test_round_trip(docs):
    rows = packing.pack(docs, VOCAB).collect()
    exact(rows, docs.collect())
    assert sum(r.length for r in rows) / 2048 > 0.6 * len({r.sequence_id for r in rows})


def test_odd_rows(odd, none):
    exact(packing.pack(odd, VOCAB).collect(), odd.collect())
    assert packing.pack(none, VOCAB).collect() == []


def test_neighbours_share_sequences(docs):
    """Documents of one language meet more often than by chance."""
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = sorted(packing.pack(docs, VOCAB).select("doc_id", "hilbert_key").distinct().collect(), key=lambda r: r.hilbert_key)
    same = np.mean([lang[a.doc_id] == lang[b.doc_id] for a, b in zip(rows, rows[1:], strict=False)])
    share = np.unique(list(lang.values()), return_counts=True)[1] / len(lang)
    assert same > 1.3 * (share**2).sum()


@pytest.mark.parametrize("most", [600_000, 20])
def test_cached_words_give_the_tokenizers_ids(most):
    rng = np.random.default_rng(0)
    letters = [*"abzABZ'sre.,!?*#$%&|()[]\"/-09 \n\t éÉÀßİΣσς’“漢字Jj\xa0\x85\x1c½²<>", "́", "̌", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    words, t = WordTokens(VOCAB, most=most), Tokenizer.from_file(VOCAB)
    for lo in range(0, len(texts), 200):
        part = texts[lo : lo + 200]
        ids, n = words.gather(*words.words([x.encode() for x in part]))
        for x, end, k in zip(part, np.cumsum(n), n, strict=True):
            assert ids[end - k : end].tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("plain", [False, True])
def test_special_tokens_are_matched_in_their_own_case_only(plain):
    rng = np.random.default_rng(1)
    pieces = [*"aZ.é \n", "Word.", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "\u0301"]
    texts = ["<|ENDOFTEXT|>", "a Word. <|ENDOFTEXT|>B, c", *["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(500)]]
    words, t = WordTokens(VOCAB, plain), Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = plain
    ids, n = words.gather(*words.words([x.encode() for x in texts]))
    for x, end, k in zip(texts, np.cumsum(n), n, strict=True):
        assert ids[end - k : end].tolist() == t.encode(x, add_special_tokens=False).ids
