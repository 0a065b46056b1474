"""Greedy word-piece counts by a linear longest-match automaton.

A trie of the vocabulary has a failure link at each node: where matching goes on
once the node's string, which the next byte doesn't extend, has been cut greedily
into its longest pieces. How many pieces that cuts off is stored with the link,
so a unit is counted in one pass over its bytes and no piece is ever built.

Defined results: a null or empty text has 0 units and 0 pieces. A byte that
begins no piece counts as one. Repeated rows are counted each; extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .encoder import vocabulary
from .runtime import documents, map_arrow

COUNTED = "doc_id long, n_units long, n_tokens long"


class Automaton:
    def __init__(self, pieces: Iterable[bytes]):
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        ends, parent, byte, n = [False], [0], [0], 1
        for piece in pieces:
            node = 0
            for c in piece:
                to = self.next.get(node << 8 | c)
                if to is None:
                    to = self.next[node << 8 | c] = n
                    ends.append(False)
                    parent.append(node)
                    byte.append(c)
                    n += 1
                node = to
            ends[node] = bool(piece)
        depth = [0] * n
        for v in range(1, n):  # a parent always has the lower number
            depth[v] = depth[parent[v]] + 1
        #: Where a failed match goes on, -1 where it can't; pieces popped on the way.
        self.fail, self.popped = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, pops = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and (z << 8 | byte[v]) not in self.next:
                z, pops = self.fail[z], pops + self.popped[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.next[z << 8 | byte[v]], pops

    def count(self, data: bytes) -> int:
        """Pieces of the greedy longest-match cut of ``data``."""
        go, fail, popped = self.next, self.fail, self.popped
        node, n, held = 0, 0, 0  # held: bytes read since the last popped piece, for strings that no piece begins
        for c in data:
            to = go.get(node << 8 | c)
            while to is None and node:
                n += popped[node]
                if fail[node] < 0:
                    return self._slow(data)
                node = fail[node]
                to = go.get(node << 8 | c)
            if to is None:
                n, node = n + 1, 0
            else:
                node = to
        while node:
            n += popped[node]
            if fail[node] < 0:
                return self._slow(data)
            node = fail[node]
        return n

    def _slow(self, data: bytes) -> int:
        """For vocabularies without all single bytes: some prefix of a match is no string of pieces."""
        at = n = 0
        while at < len(data):
            node, best = 0, 1
            for k in range(at, len(data)):
                node = self.next.get(node << 8 | data[k], -1)
                if node < 0:
                    break
                if self.popped[node] == 1 and self.fail[node] == 0:
                    best = k + 1 - at
            at, n = at + best, n + 1
        return n


def load(path: str) -> list[bytes]:
    """Pieces of a file of base64 strings and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(load(path))
    return _automata[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Units and pieces of every text; pieces never cross a unit's end."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cache = automaton(path), K.HashCache(20)
        for b in batches:
            texts = K.Texts(b.column("text"))
            p, _ = K.units(texts)
            known, n = cache.find(p.hash)
            n = n.copy()
            miss = np.flatnonzero(~known)
            if len(miss):
                fresh, back = np.unique(p.hash[miss], return_index=True)
                rep = miss[back]
                new = np.array([machine.count(texts.bytes_at(p.start[i], p.end[i])) for i in rep.tolist()], np.int64)
                n[miss] = new[np.searchsorted(fresh, p.hash[miss])]
                cache.put(fresh, new)
            sums = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(p.first)), pa.array(sums[p.first[1:]] - sums[p.first[:-1]])], ["doc_id", "n_units", "n_tokens"])

    return map_arrow(documents(docs), run, COUNTED)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    from .runtime import table

    return count_tokens(table(spark, sf_dir, "documents"))
