"""Exact pre-token splitting with worker-side caches, shared by token counting and packing.

A tokenizer's result for a text is the concatenation of its results for the text's pre-tokens.  For texts
of ASCII and Latin-1 letters the splitting patterns below agree with the tokenizer's own; any other text,
and any text that might hold a special token's string, goes to the library whole.
"""

from __future__ import annotations

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np

from blockloom.llm.common import KEPT

#: Texts of these characters alone are split here.  Outside it Unicode tables of libraries may differ.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])

#: How the two kinds of tokenizer split, for safe texts.
SPLITS = {
    "byte_bpe": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+"),
    "word_bpe": re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+"),
}


def is_safe(text: str) -> bool:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not raw.translate(None, _SAFE) and "<|" not in text


def load(path: str):
    """The library's tokenizer, on one thread: Spark's tasks are the parallelism."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Pre-tokens that a worker keeps (some 250 bytes each).
MOST_ENTRIES = 900_000


class PreTokenCache:
    """Pre-token -> value, filled for whole batches of misses and cleared when it would outgrow its bound."""

    def __init__(self, path: str, kind: str, most: int = MOST_ENTRIES):
        self.tokenizer, self.kind, self.split, self.most = load(path), kind, SPLITS[kind].findall, most
        self.found: dict = {}
        self.frequent: FrequentLengths | None = None

    def pieces(self, text: str) -> list[str]:
        return self.split(text.lower() if self.kind == "word_bpe" else text)

    def value(self, ids: list[int]):
        """What is kept of a pre-token's ids: the ids themselves, as 32-bit little-endian."""
        return array("I", ids).tobytes()

    def whole(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def fill(self, split: list[list[str]]) -> None:
        """Encode what this batch has and the cache has not."""
        missing = list(set(chain.from_iterable(split)).difference(self.found))
        if len(self.found) + len(missing) > self.most:
            self.found = {}
            missing = list(set(chain.from_iterable(split)))
        if self.frequent is not None and missing:
            missing = self.frequent.look_up(missing, self.found)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.found.update(zip(part, [self.value(x.ids) for x in got], strict=True))


class FrequentLengths:
    """A compact hash table of frequent pre-tokens' lengths in tokens: arrays with open addressing, 16 bytes a key.

    It is built once on the driver and probed for a whole array of pre-tokens at a time; workers never unfold it.
    """

    WIDTH = 16

    def __init__(self, words: list[str], lengths: list[int]):
        fit = [(w, n) for w, n in zip([x.encode() for x in words], lengths, strict=True) if len(w) <= self.WIDTH and 0 < n < 256]
        self.keys = self._keys([w for w, _ in fit])
        self.lengths = np.array([n for _, n in fit], np.uint8)
        self.bits = max(4, (2 * len(fit)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(fit)), self._slot(self.keys)
        while len(todo):  # linear probing, all keys at once
            free = np.flatnonzero(self.slots[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[first]] = todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _keys(self, words: list[bytes]) -> np.ndarray:
        return np.array(words, f"S{self.WIDTH}").view(np.uint64).reshape(-1, 2) if words else np.zeros((0, 2), np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, words: list[str], found: dict[str, int]) -> list[str]:
        """Put what the table knows into ``found``; the words that it does not know."""
        raw = [w.encode() for w in words]
        short = [i for i, w in enumerate(raw) if 0 < len(w) <= self.WIDTH]
        keys = self._keys([raw[i] for i in short])
        at, entry = self._slot(keys), np.full(len(short), -1, np.int64)
        open_ = np.arange(len(short))
        while len(open_):
            got = self.slots[at[open_]]
            hit = (got >= 0) & (self.keys[got] == keys[open_]).all(axis=1) if len(self.keys) else np.zeros(len(got), bool)
            entry[open_[hit]] = got[hit]
            open_ = open_[(got >= 0) & ~hit]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        known = np.flatnonzero(entry >= 0)
        mine = [short[i] for i in known.tolist()]
        found.update(zip([words[i] for i in mine], self.lengths[entry[known]].tolist(), strict=True))
        gone = set(mine)
        return [w for i, w in enumerate(words) if i not in gone]


class LengthCache(PreTokenCache):
    """Pre-token -> number of tokens."""

    def value(self, ids: list[int]):
        return len(ids)


def worker_cache(cls: type[PreTokenCache], path: str, kind: str, frequent: FrequentLengths | None = None, most: int = MOST_ENTRIES) -> PreTokenCache:
    """One cache per worker process, tokenizer and kind of value: later tasks of the worker find it filled, until an operator without it begins."""
    key = (cls.__name__, path, kind)
    if key not in KEPT:
        KEPT[key] = cls(path, kind, most)
    KEPT[key].most, KEPT[key].frequent = most, frequent
    return KEPT[key]


def slices(items: list[str], most_chars: int = 4 << 20):
    """Consecutive runs of texts of bounded total length (a longer text stands alone)."""
    start = total = 0
    for i, x in enumerate(items):
        if total and total + len(x) > most_chars:
            yield start, i
            start, total = i, 0
        total += len(x)
    if items:
        yield start, len(items)
