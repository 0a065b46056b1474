"""Best-fit packing of token documents into fixed-length sequences.

A document is its ids and an end id. One longer than a sequence is cut into
full-length pieces and one shorter piece in front; full pieces make sequences by
themselves. The others go through bounded-space online best fit: a fixed number
of open bins is kept in a bitset keyed by free space, a piece goes to the
fullest bin that holds it, and where none does, the fullest bin closes and a new
one opens. A task packs one share of the pieces, so tasks need nothing of each
other; only the few numbers of each short piece are shuffled, no ids. Shares
hold ``SHARE`` pieces whatever the size of the input. Pieces arrive in a fixed
pseudo-random order, which any run of a task repeats.

Defined results: a null or empty text is the end id alone. Repeated rows are
packed each; their doc_id then stands in several places. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoder import encoder, vocabulary
from .runtime import documents, map_arrow, settle

SEQUENCE, END_ID = 1024, 2
#: Bins kept open at once, and pieces that one task packs.
OPEN_BINS, SHARE = 64, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    head = n % size or size
    return [(0, min(head, n)), *((s, size) for s in range(head, n, size))]


class BestFit:
    """Open bins by free space; ``free`` has bit f set while some open bin has exactly f tokens free."""

    def __init__(self, size: int = SEQUENCE, most: int = OPEN_BINS):
        self.size, self.most, self.bins, self.free = size, most, {}, 0
        self.open, self.made = 0, 0

    def _take(self, f: int) -> int:
        stack = self.bins[f]
        b = stack.pop()
        if not stack:
            del self.bins[f]
            self.free &= ~(1 << f)
        self.open -= 1
        return b

    def _lay(self, f: int, b: int) -> None:
        if f:
            self.bins.setdefault(f, []).append(b)
            self.free |= 1 << f
            self.open += 1

    def add(self, length: int) -> tuple[int, int]:
        """Bin and place in it of the next piece."""
        room = self.free >> length
        if room:
            f = length + (room & -room).bit_length() - 1
            b = self._take(f)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            f, b = self.size, self.made
            self.made += 1
        self._lay(f - length, b)
        return b, self.size - f


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """One row for each piece of each document, with the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, off = enc.encode(b.column("text"))
            rows: list[list] = [[], [], [], [], []]
            tail = np.array([end_id], "<u4")
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                mine = np.concatenate([ids[off[i] : off[i + 1]], tail])
                raw = memoryview(mine.astype("<u4", copy=False)).cast("B")
                for k, (s, n) in enumerate(cut(len(mine), size)):
                    for x, v in zip(rows, (doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(documents(docs), run, PIECES)


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, size: int = SEQUENCE, open_bins: int = OPEN_BINS, share: int = SHARE) -> DataFrame:
    """Pieces with sequence_id and offset. Sequence ids are unique, with gaps."""
    path = path or vocabulary("byte_bpe_50k.json")
    made = settle(pieces(docs, path, end_id, size))
    n = made.where(F.col("length") < size).count()
    shares = max(1, -(-n // share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() + 1) << 36
        bins = BestFit(size, open_bins)
        for b in batches:
            placed = [bins.add(x) for x in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x, _ in placed], pa.int64()), pa.array([x for _, x in placed], pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    # the order within a share must not depend on which shuffle block came first: a task that runs again packs the same
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = made.where(F.col("length") < size).repartition(shares, order).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32")
    short = map_arrow(dealt, run, PACKED)
    full = made.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(full)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    from .runtime import table

    return pack(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
