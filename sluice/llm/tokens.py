"""Word-level cached use of a public tokenizer whose tokens never cross ASCII white space."""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import islice

import numpy as np

from .common import Codes

#: A run of punctuation that ends a word, after a letter.
TAIL = re.compile(rb"(?<=[a-z\x80-\xff])[.,;:!?*#$%&|)(\]\[\"/-]+\Z")

_CACHES: dict[tuple[str, bool], "WordTokens"] = {}


def cached(path: str, plain: bool) -> "WordTokens":
    """One cache for each worker process, kept from task to task. plain: special tokens' strings are ordinary text."""
    if (path, plain) not in _CACHES:
        _CACHES[path, plain] = WordTokens(path, plain)
    return _CACHES[path, plain]


class WordTokens:
    """Token ids of whole texts, joined from the cached ids of their words.

    Exact for a tokenizer that splits at white space and drops it: every word is
    then encoded on its own anyway. The cache forgets all beyond `most` words.
    """

    def __init__(self, path: str, plain: bool = False, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = plain
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        # Special tokens are looked for before the tokenizer lowers, so in their own case only.
        self.specials = [] if plain else [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.codes, self.known = Codes(), 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _learn(self) -> None:
        """Encode the words that got a code since the last call; they are the dictionary's newest.

        A word that ends in a letter and then punctuation is put together from the ids of
        its two parts, between which the tokenizer splits anyway.
        """
        first, whole, joined, codes = self.known, [], [], self.codes
        newest = list(islice(reversed(codes), len(codes) - first))
        newest.reverse()
        for code, word in enumerate(newest, first):
            if (at := TAIL.search(word)) and (word[at.start() - 1] < 128 or _ends_as_letter(word[: at.start()])):
                joined.append((code, codes[word[: at.start()]], codes[word[at.start() :]]))
            else:
                whole.append((code, word.decode("utf-8", "replace")))
        parts = list(islice(reversed(codes), len(codes) - first - len(newest)))
        parts.reverse()
        whole += [(code, word.decode("utf-8", "replace")) for code, word in enumerate(parts, first + len(newest))]
        self.known = len(codes)
        self.starts, self.lengths = _room(self.starts, self.known), _room(self.lengths, self.known)
        letters = [x for x in whole if x[1].isalpha()] if self.ends.any() else []
        others = [x for x in whole if not x[1].isalpha()] if letters else whole
        for i in range(0, len(letters), 500):
            # Words of letters are one piece each, told apart by its end-of-word token; if one isn't, the numbers differ.
            part = letters[i : i + 500]
            ids = np.array(self.tokenizer.encode(" ".join([w for _, w in part]), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                self._store(np.array([c for c, _ in part]), ids, np.diff(last, prepend=-1))
            else:
                others += part
        for i in range(0, len(others), 500):
            part = others[i : i + 500]
            e = self.tokenizer.encode([w for _, w in part], is_pretokenized=True, add_special_tokens=False)
            self._store(np.array([c for c, _ in part]), np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        if joined:
            made = np.array(joined)
            ids, counts = self.gather(made[:, 1:].ravel(), np.full(len(made), 2))
            self._store(made[:, 0], ids, counts)

    def _store(self, codes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[codes] = counts
        self.starts[codes] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def words(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word of all texts, number of words of each text). None has none."""
        if len(self.codes) > self.most:
            self._clear()
        # A-Z are lowered by the tokenizer too; with combining marks about, it must compose first.
        split = [(self._lower(x) if self.lowers and b"\xcc" not in x else x).split() if x else [] for x in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        codes = self.codes.of([w for s in split for w in s])
        if len(self.codes) > self.known:
            self._learn()
        return codes, counts

    def _lower(self, text: bytes) -> bytes:
        """The text in lower case, or as it is if that could make a special token of it."""
        low = text.lower()
        for s in self.specials:
            if s in low:
                return text
        return low

    def gather(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[codes] - (ends - lengths), lengths)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[at], np.diff(edge)


def _ends_as_letter(word: bytes) -> bool:
    """Whether the last character is a letter still when it is composed and lowered, so that punctuation after it is a piece of its own."""
    return unicodedata.normalize("NFC", word.decode("utf-8", "replace")[-1]).lower().isalpha()


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out
