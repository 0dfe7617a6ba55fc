"""Encoding with the tokenizers library by distinct words.

Where a tokenizer's ids for a text are the ids of its white-space separated words one after
another, each distinct word is encoded once, many together on the library's threads, and the
texts' id arrays are put together in numpy. The words' ids are remembered in a pool of bounded
size. A full pool keeps what it has, mostly the frequent words, and encodes others for the
moment only; when as many words have missed it as it holds, it starts afresh.

Words not in the pool are encoded many to a text, as a call costs much more than a short word, and the ids
are cut where a token begins (or ends) a word; where that doesn't give as many words, one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from . import ragged


def encode_joined(tokenizer, words: list[str], edge: np.ndarray, ends: bool, together: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, given as they stand in a text with what separates them, in one array, and each word's number of ids.

    `edge` tells of each id whether it begins a word (or ends one, where `ends` holds)."""
    texts = ["".join(words[lo : lo + together]) for lo in range(0, len(words), together)]
    flat, lengths = [], []
    for k, found in enumerate(tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        ids, some = np.array(found.ids, np.int32), words[k * together : (k + 1) * together]
        at = np.flatnonzero(edge[ids])
        if len(at) == len(some) and (at[-1] == len(ids) - 1 if ends else at[0] == 0):
            n = np.diff(at, prepend=-1) if ends else np.diff(at, append=len(ids))
        else:
            each = [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            ids, n = np.fromiter(chain.from_iterable(each), np.int32), np.array([len(x) for x in each], np.int64)
        flat.append(ids)
        lengths.append(n)
    return np.concatenate(flat), np.concatenate(lengths)


class _Index(dict):
    """Places of pieces; one that is missing gets the next place and is noted."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, piece):
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


class Pool:
    """Remembers the ids of pieces. `encode` gives the ids of all pieces of a list in one array, and each piece's number of ids."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 19):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.ids, self.starts, self.lengths = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.missed = 0

    def _add(self, pieces: list, have: int) -> None:
        for lo in range(0, len(pieces), 8192):
            part = pieces[lo : lo + 8192]
            new, n = self.encode(part)
            while self.used + len(new) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            while have + len(part) > len(self.starts):
                self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
            self.ids[self.used : self.used + len(new)] = new
            self.starts[have : have + len(part)] = self.used + np.cumsum(n) - n
            self.lengths[have : have + len(part)] = n
            self.used += len(new)
            have += len(part)

    def __call__(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of pieces, in one array, and the number of ids of each text."""
        if self.missed > self.limit:
            self._clear()
        have, used = len(self.index), self.used
        n = [len(x) for x in texts]
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, sum(n))
        fresh = self.index.new
        self._add(fresh, have)
        lengths = self.lengths[at]
        out = ragged.gather(self.ids, self.starts[at], lengths), ragged.sums(lengths, np.r_[0, np.cumsum(n)])
        if len(self.index) > self.limit:
            for x in fresh:
                del self.index[x]
            self.used, self.missed = used, self.missed + len(fresh)
        self.index.new = []
        return out
