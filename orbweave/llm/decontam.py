"""Benchmark decontamination by latent semantic retrieval.

Words' idf comes from all passages of all documents and items, and so does a
randomised SVD: one pass adds every passage's row, with a random sign, to one of
``RANGE`` rows and, with another sign, to one of ``SUMS`` rows; products of such
sums' columns are on average those of all passages. The first sums give the range, the
second the directions and singular values in it (by the same sums these would
come out too large). The directions are whitened (by ``WHITEN``), so that what a language's passages all share
doesn't hide the rest. Every passage of every document is
then projected: overlapping windows of 8, 16, 32, .. words, each about an eighth
of its length after the one before, sums of blocks of ``STEP`` words' vectors.
An item is held against all windows of the length next to its own, one matrix
product for a block of items; those whose latent cosine reaches ``COSINE`` are
the candidates, and nothing else is. They are confirmed by longest common
subsequence and by the item's answer (the words of its last sentence), which
also finds paraphrases.

The items are a query set, held against all rows: they go to the tasks in blocks
of at most ``ITEMS`` distinct texts, all with one idf and one SVD, so a result
doesn't depend on the blocks. Nothing of a document is shuffled.

Defined results: null or empty texts and items match nothing, and neither do
items of fewer than ``LEAST_WORDS`` words. Repeated documents are reported each.
Items of equal text are searched once and each item_id is reported once. A text
is read whole, a very long one in overlapping segments. Empty tables give no
rows. Extra columns are ignored (kept by ``remove``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import documents, map_arrow, settle

#: Words of a passage that idf and SVD see; hashed words (clashes among them matter less than the latent dimensions' number); latent dimensions; how far singular values are evened out (0 to 1).
PASSAGE, TERMS, RANK, WHITEN = 64, 1 << 14, 128, 1.0
#: Rows that passages are summed to, for the range and for what is in it; a word's weight in a passage of one distinct word; words of which a task's sums are sent at once.
RANGE, SUMS, WEIGHT, PIECE = 256, 256, 64, 512
#: Items searched at once; least words of an item; words of a block.
ITEMS, LEAST_WORDS, STEP = 8_192, 5, 4
#: Blocks projected at once; words of a segment of a long text; bits of a table of items' words.
CHUNK_BLOCKS, SEGMENT, TABLE_BITS = 1 << 9, 1 << 16, 22
#: Bits of a table that gives words their numbers; numbers x items that are a table of their own.
NUMBER_BITS, NUMBERED = 20, 1 << 25
#: Least cosine; least share of an item's words in order, with and without its answer; least share of the answer.
COSINE, PARAPHRASE, VERBATIM, ANSWER = 0.45, 0.6, 0.8, 0.5
FOUND = "doc_id long, item long, cosine double, lcs double, answer double, start_word long, n_words long"
LEAKS = FOUND.replace("item long", "item_id long")


def _terms(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int64)


class Sums(np.lib.mixins.NDArrayOperatorsMixin):
    """Signed sums of each hashed word, in pieces (first, sums) that stay in the shared folder: only where an array is asked for does the driver hold it."""

    def __init__(self, pieces: DataFrame):
        self.pieces = pieces

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return _whole((r["first"], r["sums"]) for r in self.pieces.toLocalIterator()).astype(dtype or np.float32, copy=False)

    def __array_ufunc__(self, ufunc, method: str, *inputs, **named):
        return getattr(ufunc, method)(*(np.asarray(x) for x in inputs), **named)

    def words(self, idf: np.ndarray, rank: int, whiten: float) -> np.ndarray:
        """Each hashed word's latent vector times its idf, in half precision: one task's, as sums have one size whatever was read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = _whole(r for b in batches for r in zip(b.column("first").to_pylist(), b.column("sums"), strict=True))
            sums *= idf[:, None] / WEIGHT
            words = subspace(sums[:, :RANGE].T, sums[:, RANGE:].T, rank, whiten) * idf[:, None]
            words *= 256 / max(float(np.abs(words).max()), 1e-30)  # cosines don't change, and half precision has the range
            yield pa.RecordBatch.from_arrays([pa.array([words.astype(np.float16).tobytes()], pa.binary())], ["words"])

        told = map_arrow(self.pieces.coalesce(1), run, "words binary").collect()
        return np.frombuffer(told[0]["words"], np.float16).reshape(TERMS, -1) if told else np.zeros((TERMS, rank), np.float16)


def _whole(pieces: Iterable[tuple]) -> np.ndarray:
    out = np.zeros((TERMS, RANGE + SUMS), np.float32)
    for i, part in pieces:
        out[i : i + PIECE] = np.frombuffer(part.as_buffer() if isinstance(part, pa.Scalar) else part, np.float32).reshape(-1, out.shape[1])
    return out


def passage_sums(texts: DataFrame) -> tuple[Sums, np.ndarray, int]:
    """Of all passages of all texts (doc_id, text): each hashed word's ``RANGE`` + ``SUMS`` signed sums, in how many passages it is, and how many there are.

    A passage is in one sum of each kind, which and with what signs by hash of
    document and place, its distinct words with a weight of about one over the
    root of their number. Weights are whole numbers, so the order of adding doesn't matter.
    """

    wide = RANGE + SUMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros(TERMS, np.int64), np.zeros(TERMS * wide, np.int32), 0
        for b in batches:
            p = K.words(b.column("text"))
            if not len(p):
                continue
            count = np.diff(p.first)
            blocks = -(-count // PASSAGE)
            doc, first = p.doc(), np.cumsum(blocks) - blocks
            place = (np.arange(len(p)) - p.first[doc]) // PASSAGE
            key = np.sort((first[doc] + place) * TERMS + _terms(p.hash))
            key = key[np.append(True, key[1:] != key[:-1])]
            passage, term = key // TERMS, key & (TERMS - 1)
            total += np.bincount(term, minlength=TERMS)
            of = np.repeat(np.arange(len(count)), blocks)
            ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            with np.errstate(over="ignore"):
                # by its words too: ids needn't differ
                h = K.mix(K.mix(ids)[of] + (np.arange(len(of)) - first[of]).astype(np.uint64) + p.hash[p.first[of]])
            weight = np.rint(WEIGHT / np.sqrt(np.bincount(passage, minlength=len(of)))).astype(np.int32)
            for k, (at, size) in enumerate(((0, RANGE), (RANGE, SUMS))):
                own = h >> np.uint64(32 * k) & np.uint64((1 << 31) - 1)
                sign = np.where(h >> np.uint64(31 + 32 * k) & np.uint64(1), -weight, weight)
                np.add.at(sums, term * wide + (at + own % np.uint64(size)).astype(np.int64)[passage], sign[passage])
            n += len(of)
        sums = sums.reshape(TERMS, wide)
        kind = np.int16 if max(int(sums.max()), -int(sums.min())) < 1 << 15 else np.int32
        for i in range(0, TERMS * (n > 0), PIECE):
            part = [sums[i : i + PIECE].astype(kind).tobytes(), total[i : i + PIECE].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([i]), *(pa.array([x], pa.binary()) for x in part), pa.array([n])], ["first", "sums", "total", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for b in batches:
            for i, s, t, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s = np.frombuffer(s, np.int16 if len(s) == 2 * PIECE * wide else np.int32)
                kept = own.setdefault(i, [np.zeros(PIECE * wide, np.int64), np.zeros(PIECE, np.int64), 0])
                kept[0] += s
                kept[1] += np.frombuffer(t, np.int64)
                kept[2] += n
        for i, (s, t, n) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([s.astype(np.float32).tobytes()], pa.binary()), pa.array([t.tobytes()], pa.binary()), pa.array([n])], ["first", "sums", "total", "n"])

    schema = "first long, sums binary, total binary, n long"
    # a task's sums have one size however much it reads, so tasks are as many as keep all cores busy
    cores = texts.sparkSession.sparkContext.defaultParallelism
    parts = map_arrow(texts.coalesce(2 * cores), run, schema)
    added = settle(map_arrow(parts.repartition("first").coalesce(cores), add, schema))
    df, n = np.zeros(TERMS, np.int64), 0
    for r in added.select("first", "total", "n").collect():
        i, n = r["first"], r["n"]
        df[i : i + PIECE] = np.frombuffer(r["total"], np.int64)
    return Sums(added.select("first", "sums")), df, n


@dataclass
class Item:
    key: int
    hashes: np.ndarray
    answer: np.ndarray


@dataclass
class Scale:
    """Items that windows of one length are held against: their unit vectors and numbers."""

    blocks: int
    latent: np.ndarray
    items: np.ndarray


@dataclass
class Search:
    """What a task needs to look for a block of items. ``source`` has each hashed word's latent vector times its idf in half precision."""

    items: list[Item]
    source: np.ndarray | Broadcast
    scales: list[Scale]
    cosine: float = COSINE
    masks: list[dict[int, int]] | None = None
    member: np.ndarray | None = None
    number: np.ndarray | None = None
    holds: np.ndarray | None = None
    _words: np.ndarray | None = None

    @property
    def words(self) -> np.ndarray:
        if self._words is None:
            self._words = _single(self.source)
        return self._words

    def __getstate__(self) -> dict:
        return self.__dict__ | {"masks": None, "member": None, "number": None, "holds": None, "_words": None}


def _single(source: np.ndarray | Broadcast) -> np.ndarray:
    """Full precision, and a row of zeros."""
    half = source if isinstance(source, np.ndarray) else source.value
    return np.concatenate([half, np.zeros((1, half.shape[1]), half.dtype)]).astype(np.float32)


def _last_sentence(text: str) -> str:
    parts = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    return parts[-1] if parts else ""


def subspace(rows: np.ndarray, others: np.ndarray, rank: int, whiten: float = WHITEN) -> np.ndarray:
    """About the first right singular vectors of both, each divided by its singular value to the power ``whiten``: ``rows`` give the range, ``others`` vectors and values in it."""
    values, turn = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    values, turn = values[-rank:], turn[:, -rank:]
    values = np.maximum(values, 1e-7 * max(float(values.max()), 1e-12))
    q = rows.T @ (turn / np.sqrt(values)).astype(np.float32)
    part = others @ q
    values, turn = np.linalg.eigh((part.T @ part).astype(np.float64))
    values = np.maximum(values, 1e-6 * max(float(values.max()), 1e-12))
    return np.ascontiguousarray(q @ (turn * values ** (-whiten / 2)).astype(np.float32))


def latent_words(docs: DataFrame, items: DataFrame, rank: int = RANK, whiten: float = WHITEN) -> Broadcast:
    """Each hashed word's latent vector times its idf: both from all passages of all documents and items."""
    sums, df, n = passage_sums(documents(docs).unionByName(documents(items.select(F.col("key").alias("doc_id"), "text"))))
    idf = (np.log((n + 1) / (df + 1)) + 0.05).astype(np.float32)
    return docs.sparkSession.sparkContext.broadcast(sums.words(idf, rank, whiten))


def scale_of(n: int) -> int:
    """Blocks of the windows that items of n words are held against: a power of two, next to n on a log scale."""
    return max(2, 1 << max(0, round(np.log2(max(n, 1) / STEP))))


def index(texts: list[tuple[int, str]], source: np.ndarray | Broadcast, cosine: float = COSINE) -> Search:
    """The search for items (key, text)."""
    words = _single(source)
    whole, answers = (K.words(pa.array([f(t) for _, t in texts], pa.string())) for f in (str, _last_sentence))
    items = []
    for i, (key, _) in enumerate(texts):
        h = whole.hash[whole.first[i] : whole.first[i + 1]]
        if len(h) >= LEAST_WORDS:
            items.append(Item(key, h, answers.hash[answers.first[i] : answers.first[i + 1]]))
    scales = []
    of = np.array([scale_of(len(it.hashes)) for it in items], np.int64)
    for m in np.unique(of).tolist():
        mine = np.flatnonzero(of == m)
        latent = np.stack([words[_terms(items[i].hashes)].sum(0) for i in mine.tolist()])
        scales.append(Scale(m, _unit(latent), mine))
    return Search(items, source, scales, cosine)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; one machine-word-like row of bits for a, one step for each of b."""
    return _lcs(_masks(a), len(a), b)


def _masks(a: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _lcs(masks: dict[int, int], n: int, b: np.ndarray, least: float = 0.0) -> int:
    """``lcs`` with the masks of a, of length n; 0 where too few words of b are in a to reach ``least``."""
    steps = [m for x in b.tolist() if (m := masks.get(x))]
    if len(steps) < least:
        return 0
    full = (1 << n) - 1
    row = full
    for m in steps:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _blocks(h: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors of each ``STEP`` words of segments ``first[i]:first[i + 1]`` of h, and each segment's first block."""
    length = np.diff(first)
    count = -(-length // STEP)
    at = np.concatenate([[0], np.cumsum(count)])
    # the row behind the last word's is zero: it fills a segment's last block
    term = np.full(at[-1] * STEP, len(words) - 1, np.int64)
    term[K.ragged(at[:-1] * STEP, length)] = _terms(h)
    term = term.reshape(-1, STEP)
    out = np.empty((len(term), words.shape[1]), np.float32)
    for i in range(0, len(term), CHUNK_BLOCKS):  # pieces that stay in the processor's cache
        part = out[i : i + CHUNK_BLOCKS]
        np.take(words, term[i : i + CHUNK_BLOCKS, 0], axis=0, out=part, mode="clip")
        for k in range(1, STEP):
            part += words[term[i : i + CHUNK_BLOCKS, k]]
    return out, at


def candidates(h: np.ndarray, first: np.ndarray, s: Search) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(segments, first words in them, items, cosines, words of the window) whose cosines reach the least, scale by scale."""
    sums, at = _blocks(h, first, s.words)
    n = len(sums)
    segment = np.repeat(np.arange(len(first) - 1), np.diff(at))
    last = at[1:][segment]  # where the segment of a block ends
    size = 1
    for scale in s.scales:
        while size < scale.blocks:  # windows of twice the length: with the one that follows, where that is in the segment
            more = np.arange(n) + size < last
            grown = sums.copy()
            grown[more] += sums[np.flatnonzero(more) + size]
            sums, size = grown, 2 * size
        hop = max(1, size // 8)
        # a window that hangs over the end holds nothing that an earlier one doesn't, save a segment's only one
        place = np.arange(n) - at[segment]
        pick = np.flatnonzero((place % hop == 0) & ((np.arange(n) + size < last + hop) | (place == 0)))
        for lo in range(0, len(pick), 1 << 13):
            part = pick[lo : lo + (1 << 13)]
            z = _unit(sums[part])
            for k in range(0, len(scale.items), 1 << 10):
                near = z @ scale.latent[k : k + (1 << 10)].T
                row, col = np.nonzero(near >= s.cosine)
                if len(row):
                    b = part[row]
                    yield segment[b], (b - at[segment[b]]) * STEP, scale.items[k + col], near[row, col], size * STEP


def _segments(p: K.Pieces, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of segments of at most about ``SEGMENT`` words, and the text of each; those of one text overlap by twice the longest window."""
    count = np.diff(p.first)
    hop = max(SEGMENT, 4 * longest)
    parts = np.maximum(1, -(-np.maximum(count - 2 * longest, 1) // hop)) * (count > 0)
    doc = np.repeat(np.arange(len(count)), parts)
    return p.first[doc] + hop * K.ragged(np.zeros(len(count), np.int64), parts), doc


def find(p: K.Pieces, s: Search) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """(document, item's key, cosine, lcs share, answer share, first word, words) of every leak, the best for each item."""
    if not len(p) or not s.scales:
        return
    if s.masks is None:
        s.masks = [_masks(it.hashes) for it in s.items]
        _index_words(s)
    longest = STEP * s.scales[-1].blocks
    begin, doc = _segments(p, longest)
    hop = max(SEGMENT, 4 * longest)
    end = np.minimum(begin + hop + 2 * longest, p.first[doc + 1])
    i = 0
    while i < len(begin):  # whole documents, until some words are together
        j = i + 1
        while j < len(begin) and (doc[j] == doc[j - 1] or int((end[i:j] - begin[i:j]).sum()) < SEGMENT):
            j += 1
        length = end[i:j] - begin[i:j]
        h = p.hash[K.ragged(begin[i:j], length)]
        first = np.concatenate([[0], np.cumsum(length)])
        seen: list[list[np.ndarray]] = []
        for segment, place, item, near, size in candidates(h, first, s):
            seen.append([doc[i + segment], item, near, begin[i + segment] + place, np.full(len(item), size)])
        if seen:
            yield from _confirm(p, s, *map(np.concatenate, zip(*seen, strict=True)))
        i = j


def _index_words(s: Search) -> None:
    """Which words an item may hold, for sure all that it does: by their numbers and item where that table is small, else by a hash of both."""
    slots = np.unique(np.concatenate([_numbered(it.hashes) for it in s.items]))
    if (len(slots) + 1) * len(s.items) <= NUMBERED:
        s.number = np.zeros(1 << NUMBER_BITS, np.int32)
        s.number[slots] = 1 + np.arange(len(slots))
        s.holds = np.zeros((len(s.items), len(slots) + 1), bool)
        for k, it in enumerate(s.items):
            s.holds[k, s.number[_numbered(it.hashes)]] = True
        return
    s.member = np.zeros(1 << TABLE_BITS, bool)
    for k, it in enumerate(s.items):
        s.member[_slots(it.hashes, np.uint64(k))] = True


def _numbered(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - NUMBER_BITS)).astype(np.int32)


def _slots(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Places of items' words in the table that says which words an item may hold."""
    with np.errstate(over="ignore"):
        return ((h ^ (item + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _regions(p: K.Pieces, s: Search, doc: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As far as an item may reach where a window holds its middle, and whether enough of the region's words can be in the item."""
    n = np.array([len(it.hashes) for it in s.items], np.int64)[item]
    side = np.maximum(size // 8, (n - size) // 2) + n // 4
    a, b = np.maximum(p.first[doc], start - side), np.minimum(p.first[doc + 1], start + size + side)
    enough = np.zeros(len(a), bool)
    least = int(a.min()) if len(a) else 0
    number = s.number[_numbered(p.hash[least : int(b.max())])] if s.holds is not None and len(a) else None
    for lo in range(0, len(a), 1 << 11):  # pieces that stay in the processor's cache
        hi = min(len(a), lo + (1 << 11))
        length = b[lo:hi] - a[lo:hi]
        at = K.ragged(a[lo:hi], length)
        if number is not None:
            hit = s.holds.ravel()[number[at - least] + np.repeat(item[lo:hi] * s.holds.shape[1], length)]
        else:
            hit = s.member[_slots(p.hash[at], np.repeat(item[lo:hi], length).astype(np.uint64))]
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        ends = np.cumsum(length)
        enough[lo:hi] = sums[ends] - sums[ends - length] >= PARAPHRASE * n[lo:hi]
    return a, b, enough


def _confirm(p: K.Pieces, s: Search, doc: np.ndarray, item: np.ndarray, near: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
    """Leaks among candidates, likeliest windows of a document and item first; a window inside a text already read isn't read again."""
    a, b, enough = _regions(p, s, doc, item, start, size)
    doc, item, near, start, size, a, b = (x[enough] for x in (doc, item, near, start, size, a, b))
    order = np.lexsort((start, -near, item, doc))
    at, best, read = None, None, []
    for d, k, c, lo, n, a, b in zip(*(x[order].tolist() for x in (doc, item, near, start, size, a, b)), strict=True):
        if at != (d, k):
            if best:
                yield best
            at, best, read = (d, k), None, []
        if any(x <= lo and lo + n <= y for x, y in read):
            continue
        it = s.items[k]
        read.append((a, b))
        region, n_words = p.hash[a:b], len(it.hashes)
        if best and best[3] >= 1:
            continue
        mine = region if s.holds is None else region[s.holds[k, s.number[_numbered(region)]]]
        # as many of its words as the best region's, and one more, or it can't be better
        least = max(PARAPHRASE * n_words, best[3] * n_words + 0.5 if best else 0)
        share = _lcs(s.masks[k], n_words, mine, least) / n_words
        if share < PARAPHRASE or (best and share <= best[3]):
            continue
        answer = float(np.isin(it.answer, region).mean()) if len(it.answer) else 1.0
        if share >= VERBATIM or answer >= ANSWER:
            best = (d, it.key, c, share, answer, a - int(p.first[d]), b - a)
    if best:
        yield best


def _items(benchmark: DataFrame) -> DataFrame:
    """Distinct texts and their keys."""
    return benchmark.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select(F.xxhash64("text").alias("key"), "text")


def searches(docs: DataFrame, benchmark: DataFrame, **sizes) -> Iterator[Search]:
    """One search for each block of at most ``ITEMS`` texts, read one after the other; all share idf and SVD."""
    own = _items(benchmark)
    words = None
    block: list[tuple[int, str]] = []
    for r in own.orderBy("key", "text").toLocalIterator():
        if words is None:
            words = latent_words(docs, own, **sizes)
        block.append((r["key"], r["text"]))
        if len(block) == ITEMS:
            yield index(block, words)
            block = []
    if block:
        yield index(block, words)


def leaks(docs: DataFrame, benchmark: DataFrame, **sizes) -> DataFrame:
    """Documents and the items whose passages they hold."""
    out = None
    for search in searches(docs, benchmark, **sizes):

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], *rest) for d, *rest in find(K.words(b.column("text")), search)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64() if k in (2, 3, 4) else pa.int64()) for k in range(7)], [c.split()[0] for c in FOUND.split(", ")])

        part = map_arrow(documents(docs), run, FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], LEAKS)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("item")).distinct()
    return out.join(named, "item").select(*[c.split()[0] for c in LEAKS.split(", ")])


def remove(docs: DataFrame, benchmark: DataFrame, **sizes) -> DataFrame:
    """The documents without a leak, with all their columns."""
    kept = docs
    for search in searches(docs, benchmark, **sizes):

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                for d, *_ in find(K.words(b.column("text")), search):
                    ok[d] = False
                yield b.filter(pa.array(ok))

        kept = map_arrow(kept, run, docs.schema)
    return kept


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    from .runtime import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    from .runtime import table

    return remove(docs, table(spark, sf_dir, "benchmark"))
