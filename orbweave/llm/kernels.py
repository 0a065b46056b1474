"""Array kernels over Arrow text columns: units, words, hashes and bounded caches.

Everything here works on whole batches of texts with numpy. A text is cut into

* *units*: a run of ASCII white space with the run of other bytes behind it, cut
  once more where one of ``. , ; : ! ?`` follows an ASCII letter. No tokenizer
  used here has a token across such a cut, so ids of a text are the ids of its
  units one after the other.
* *words*: runs of ASCII letters, digits, ``_`` and bytes from 128 up, after
  Unicode lower-casing.

Both are hashed to 64 bits with a sum of random byte values times powers of an
odd number, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_MUL = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1

_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_WORD = _LETTER.copy()
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("_")] = True
_WORD[128:] = True
#: Lead bytes of every white-space character beyond ASCII (U+0085, U+00A0, U+1680, U+2000.., U+3000).
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse, for n positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK)
        for base in (_MUL, pow(_MUL, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers.append(np.multiply.accumulate(steps))
        _powers[:] = _powers[-2:]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


class Texts:
    """The bytes of one Arrow text column; a null counts as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "") if column.null_count else column
        if lower:
            column = pc.utf8_lower(column)
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        self.column = column
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[off[0] : off[-1]] if len(off) else whole[:0]
        self.off = off - off[0] if len(off) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.off) - 1

    def bytes_at(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


class Pieces:
    """start, end and hash of each piece, and of each text the range first[i]:first[i+1] of its pieces."""

    def __init__(self, texts: Texts, start: np.ndarray, end: np.ndarray):
        self.texts, self.start, self.end = texts, start, end
        self.hash = _hashes(texts.data, start, end)
        self.first = np.searchsorted(start, texts.off)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))

    def string(self, i: int) -> str:
        return self.texts.bytes_at(self.start[i], self.end[i]).decode("utf-8", "replace")


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        # as many pieces as fit a block; a single longer piece gets one of its own
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _pow(hi - lo + 1)
        values = _BYTE_VALUE[data[lo:hi]]
        with np.errstate(over="ignore"):
            values *= up[: hi - lo]
            edges = np.empty(2 * (j - i), np.int64)
            edges[0::2], edges[1::2] = start[i:j] - lo, end[i:j] - lo
            cut = edges[:-1] if edges[-1] == hi - lo else edges
            out[i:j] = np.add.reduceat(values, cut)[0::2] * down[start[i:j] - lo]
            # a length term tells apart what trailing zero values could not
            out[i:j] += (end[i:j] - start[i:j]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def units(texts: Texts) -> tuple[Pieces, np.ndarray]:
    """Units of all texts, and which texts may hold wide white space (cut those with the tokenizer itself)."""
    data, off = texts.data, texts.off
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Pieces(texts, empty, empty), np.zeros(len(texts), bool)
    space = _SPACE[data]
    begin = np.empty(len(data), bool)
    begin[0] = True
    begin[1:] = space[1:] & ~space[:-1]
    begin[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    begin[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(data))
    odd = np.zeros(len(texts), bool)
    at = np.flatnonzero(_WIDE_SPACE[data])
    if len(at):
        nxt = data[np.minimum(at + 1, len(data) - 1)]
        lead = data[at]
        hit = ((lead == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))) | ((lead == 0xE1) & (nxt == 0x9A)) | ((lead == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((lead == 0xE3) & (nxt == 0x80))
        odd[np.searchsorted(off, at[hit], "right") - 1] = True
    control = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
    odd[np.searchsorted(off, control, "right") - 1] = True
    return Pieces(texts, start, end), odd


def words(column: pa.Array) -> Pieces:
    """Words of all texts, lower-cased."""
    texts = Texts(column, lower=True)
    data, off = texts.data, texts.off
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Pieces(texts, empty, empty)
    word = _WORD[data]
    begin, stop = word.copy(), np.empty(len(data), bool)
    begin[1:] &= ~word[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    begin[heads] = word[heads]
    stop[:-1] = word[:-1] & ~word[1:]
    stop[-1] = word[-1]
    tails = off[1:][off[1:] > 0] - 1
    stop[tails] = word[tails]
    return Pieces(texts, np.flatnonzero(begin), np.flatnonzero(stop) + 1)


def shingles(p: Pieces, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of a text (of all its words, if fewer), and the number of each text's text."""
    count = np.diff(p.first)
    doc = p.doc()
    h = np.zeros(len(p), np.uint64)
    mul = np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = np.zeros(len(p), np.uint64)
            part[: max(0, len(p) - k)] = p.hash[k:]
            # past the end of a text with fewer than n words nothing is added
            inside = np.arange(len(p)) + k < p.first[doc + 1] if len(p) else np.zeros(0, bool)
            h = h * mul + np.where(inside, part, np.uint64(0))
    place = np.arange(len(p)) - p.first[doc]
    keep = place < np.maximum(1, count - n + 1)[doc] if len(p) else np.zeros(0, bool)
    return mix(h[keep]), doc[keep]


class HashCache:
    """A direct-mapped cache from 64-bit hashes to numbers; of bounded size, the last of two that clash stays."""

    def __init__(self, bits: int = 20, dtype=np.int64):
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.value = np.zeros(1 << bits, dtype)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (h & self.mask).astype(np.int64)
        return self.key[slot] == h, self.value[slot]

    def put(self, h: np.ndarray, value: np.ndarray) -> None:
        # of several new hashes in one slot one stays, with its own value
        slot, one = np.unique((h & self.mask).astype(np.int64), return_index=True)
        self.key[slot], self.value[slot] = h[one], value[one]

    def clear(self) -> None:
        self.key[:] = 0


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[0], start[0]+1, .. (length[0] of them), then those of the next range, and so on."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = start - (np.cumsum(length) - length)
    return np.repeat(shift, length) + np.arange(total)


def grams(p: Pieces, which: np.ndarray, sizes: range) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams (n in ``sizes``, at most 6) of the chosen pieces with a mark at either end, and for each its place in ``which``."""
    length = p.end[which] - p.start[which] + 2
    first = np.cumsum(length) - length
    total = int(length.sum())
    data = np.full(total + 8, 0xFF, np.uint64)
    data[ragged(first + 1, length - 2)] = p.texts.data[ragged(p.start[which], length - 2)]
    owner = np.repeat(np.arange(len(which)), length)
    left = first[owner] + length[owner] - np.arange(total) if total else np.zeros(0, np.int64)
    out, of = [], []
    code = np.zeros(total, np.uint64)
    for n in range(1, max(sizes) + 1):
        code |= data[n - 1 : n - 1 + total] << np.uint64(8 * (n - 1))
        if n in sizes:
            ok = left >= n
            out.append(mix(code[ok] | np.uint64(n << 56)))
            of.append(owner[ok])
    return np.concatenate(out), np.concatenate(of)
