"""Ids of whole Arrow text columns by a ``tokenizers`` file, unit by unit.

Each distinct unit is given to the library once per worker and kept in a bounded
cache; the ids of a text are its units' ids in order, which equals encoding the
text at once (see ``kernels``; tested against the library). Texts with white
space beyond ASCII or control separators, which the cuts don't know, go to the
library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Longer units and odd texts aren't cached. Ids kept in a worker; entries in its hash table (a power of two).
MAX_UNIT, ARENA, TABLE_BITS = 256, 1 << 23, 21


def tokenizer(path: str):
    """The tokenizer of a file, on one thread, reading control strings in texts as text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.cache = K.HashCache(TABLE_BITS)
        self.arena = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, lists: list[list[int]]) -> np.ndarray:
        """Append ids to the arena; start * 2**24 + length of each."""
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(length.sum())
        while self.used + total > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(len(self.arena), np.uint32)])
        start = self.used + np.cumsum(length) - length
        self.arena[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.uint32, total)
        self.used += total
        return (start << 24) | length

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and len(column) + 1 offsets into them."""
        texts = K.Texts(column)
        n = len(texts)
        if self.used > ARENA:
            self.cache.clear()
            self.used = 0
        p, odd = K.units(texts)
        if not len(p):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        plain = ~np.repeat(odd, np.diff(p.first))
        known, at = self.cache.find(p.hash)
        at = at.copy()
        miss = np.flatnonzero(~known & plain)
        if len(miss):
            fresh, back = np.unique(p.hash[miss], return_index=True)
            rep = miss[back]
            new = self._add(self._library([p.string(i) for i in rep.tolist()]))
            at[miss] = new[np.searchsorted(fresh, p.hash[miss])]
            short = (p.end - p.start)[rep] <= MAX_UNIT
            self.cache.put(fresh[short], new[short])
        length = at & ((1 << 24) - 1)
        if odd.any():
            whole = np.flatnonzero(odd)
            heads = p.first[whole]
            length[~plain] = 0
            at[heads] = self._add(self._library([texts.column[int(i)].as_py() for i in whole]))
            length[heads] = at[heads] & ((1 << 24) - 1)
        ids = self.arena[K.ragged(at >> 24, length)]
        sums = np.concatenate([[0], np.cumsum(length)])
        return ids, sums[p.first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file; its cache outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
