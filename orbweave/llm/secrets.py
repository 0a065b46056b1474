"""Secret scans: three base rules and a character convolutional network.

Base rules find assigned values, access keys and long hex strings. Every other
run of ``LEAST`` value characters or more is a candidate; a small convolutional
network in numpy reads it with its surroundings, in overlapping windows as far
as it goes, and adds it, as kind ``model``, where the highest calibrated
probability of a window reaches a threshold.

All distinct windows of all documents' candidates are used, without a bound: by hash
five eighths for the network's weights, two for calibration and one for the threshold.
Those of base findings are secrets. Of the others nobody said that
they are none: a first network is trained as if, those that it finds ``STANDS_OUT``
of the way from the rest to the secrets are left out, ``LEFT_OUT`` of all at most,
and the network is trained again, ``ROUNDS`` times. Half of the secrets have
their surroundings blanked, so the value itself must tell. The threshold is the highest that keeps the wanted recall on secrets, as they stand and
blanked. Quantiles and calibration count all logits, in steps of 1 / ``STEPS_OF_ONE``.

Windows are dealt by hash into shares, one for each ``SHARE`` of them. Each share's
task learns from a part of its windows and the shares' networks are averaged, in
``MEETINGS`` turns, until each window has been learned from; a label too rare for
shares is given to all of them.

Defined results: a null or empty text has no spans. Repeated rows are scanned
each. Offsets are code points, ends exclusive. Where all documents hold fewer
than ``LEAST_LEARNED`` windows of a label nothing is added; where a split would
hold fewer than that, all windows serve all three ends. Extra columns are
ignored (kept by ``redact``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import documents, map_arrow, scratch, settle

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_IS_VALUE = np.zeros(256, bool)
_IS_VALUE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[[ord(c) for c in "0123456789"]] = True
#: Least characters of a candidate; characters a window has before and from its place, first the candidate's start; from there to the next window's.
LEAST, BEFORE, AFTER, STEP = 12, 32, 56, 28
#: Windows of a label learned from at least; recall wanted; see above.
LEAST_LEARNED, RECALL, ROUNDS, STANDS_OUT, LEFT_OUT, STEPS_OF_ONE = 8, 0.98, 2, 0.3, 0.04, 1024
#: Windows of a share; shares at most; turns of several shares; windows of the rarer label in a share, else all shares have all of them.
SHARE, BUCKETS, MEETINGS, FEW = 1 << 15, 256, 8, 64
#: Windows without and with a secret in a step; steps of a training at least; windows that a task remembers to tell each once.
BATCH, LEAST_STEPS, REMEMBERED = (96, 32), 400, 1 << 18
SCANNED = "doc_id long, spans array<struct<kind:string,start:int,end:int>>, scores array<double>"


def base_spans(text: str, hexes: bool = True) -> list[tuple[str, int, int]]:
    """Findings of the base rules, by start and then kind. ``hexes``: False if no run of 32 hex digits is in it."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if hexes:
        found += [("hex", *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    return in_order(found)


def in_order(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _runs(ok: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``ok`` that are ``least`` long, cut where a text ends."""
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head, tail = ok.copy(), ok.copy()
    head[1:] &= ~ok[:-1]
    tail[:-1] &= ~ok[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(ok))]
    head[inner] = ok[inner]
    tail[inner - 1] = ok[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def _symbols() -> tuple[np.ndarray, int]:
    """A number for each byte: letters whatever their case, one for digits, one for each mark, the rest together."""
    table = np.zeros(256, np.int64)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = table[ord(c.upper())] = k + 1
    table[_IS_DIGIT] = 27
    for k, c in enumerate("\"'=:-_./+ \n"):
        table[ord(c)] = 28 + k
    return table, 39


_SYMBOL, _N_SYMBOLS = _symbols()
CHANNELS = _N_SYMBOLS + 3  # and upper case, hex digit, inside the candidate


def _rows_of_codes() -> np.ndarray:
    """The channels of each code: a byte (0 to 255), 256 more inside the candidate, 512 for nothing."""
    out = np.zeros((513, CHANNELS), np.float32)
    a = np.arange(256)
    for first in (0, 256):
        out[first + a, _SYMBOL] = 1
        out[first + a, _N_SYMBOLS] = (a >= 65) & (a <= 90)
        out[first + a, _N_SYMBOLS + 1] = _IS_HEX
    out[256:512, _N_SYMBOLS + 2] = 1
    return out


_CHANNELS_OF = _rows_of_codes()


def picture(code: np.ndarray) -> np.ndarray:
    """Windows of codes with one column for each channel."""
    return _CHANNELS_OF[code]


@dataclass
class Network:
    """Convolution over ``WIDTH`` bytes, rectified, the most and the mean of each filter, one logistic unit."""

    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    WIDTH = 5
    FILTERS = 16

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        n = cls.WIDTH * CHANNELS
        return cls((rng.normal(size=(n, cls.FILTERS)) * np.sqrt(2 / 12)).astype(np.float32) * 0.5, np.zeros(cls.FILTERS, np.float32), (rng.normal(size=2 * cls.FILTERS + 1) * 0.1).astype(np.float32))

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x, np.float32)

    def _spread(self) -> np.ndarray:
        """The convolution as one matrix: of each channel, what it gives to the filters at each of ``WIDTH`` places."""
        return self.conv.reshape(self.WIDTH, CHANNELS, self.FILTERS).transpose(1, 0, 2).reshape(CHANNELS, -1)

    def forward(self, cols: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, width, _ = cols.shape
        part = (cols.reshape(n * width, -1) @ self._spread()).reshape(n, width, self.WIDTH, self.FILTERS)
        ends = width - self.WIDTH + 1
        z = sum(part[:, k : k + ends, k] for k in range(self.WIDTH)) + self.bias
        a = np.maximum(z, 0)
        top = a.argmax(1)
        feats = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1), np.ones((len(a), 1), np.float32)], 1)
        return feats @ self.out, (z, top, feats)

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.asarray(z, float) + self.shift, -40, 40)))

    def logits(self, code: np.ndarray) -> np.ndarray:
        """Of windows of codes: what each byte adds to the filters is looked up, as many windows at a time as a core's cache holds."""
        table = (_CHANNELS_OF @ self._spread()).reshape(-1, self.WIDTH, self.FILTERS)
        tables = [np.ascontiguousarray(table[:, k]) for k in range(self.WIDTH)]
        n = BEFORE + AFTER - self.WIDTH + 1
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(code), 64):
            a = np.repeat(self.bias[None], n * len(code[i : i + 64]), 0).reshape(-1, n, self.FILTERS)
            for k, t in enumerate(tables):
                a += t.take(code[i : i + 64, k : k + n], 0)
            np.maximum(a, 0, out=a)
            out.append(np.concatenate([a.max(1), a.mean(1), np.ones((len(a), 1), np.float32)], 1) @ self.out)
        return np.concatenate(out)

    def scores(self, code: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of windows of codes."""
        return self._calibrated(self.logits(code))

    def train(self, windows: tuple[np.ndarray, np.ndarray], rng: np.random.Generator, least: int) -> None:
        """Learn from each window of both labels (0, 1) once or more, in ``least`` steps or more; both labels weigh the same."""
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.conv, self.bias, self.out)]
        steps = max(least, *(-(-len(x) // size) for x, size in zip(windows, BATCH, strict=True)))
        # each label's windows in another order each time that they are through
        order = [np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps * size // len(x)))] if len(x) else [np.zeros(0, np.int64)]) for x, size in zip(windows, BATCH, strict=True)]
        for t in range(1, steps + 1):
            pick = [x[o[(t - 1) * size : t * size]] for x, o, size in zip(windows, order, BATCH, strict=True)]
            code = np.concatenate(pick).astype(np.int64)
            y = np.repeat([0.0, 1.0], [len(c) for c in pick])
            weight = np.concatenate([np.full(len(c), 0.5 / max(1, len(c))) for c in pick])
            # half of all examples lose what stands around the candidate
            blind = rng.random(len(code)) < 0.5
            code[blind] = blanked(code[blind])
            cols = self._columns(picture(code))
            z, (pre, top, feats) = self.forward(cols)
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight)[:, None].astype(np.float32)
            g_out = feats.T @ d[:, 0]
            g_feat = d @ self.out[None, :]
            g = np.repeat(g_feat[:, None, self.FILTERS : 2 * self.FILTERS] / pre.shape[1], pre.shape[1], 1)
            np.put_along_axis(g, top[:, None], np.take_along_axis(g, top[:, None], 1) + g_feat[:, None, : self.FILTERS], 1)
            g = g * (pre > 0)
            # the last places reach into the next window
            full = np.zeros((len(g), cols.shape[1], self.FILTERS), np.float32)
            full[:, : g.shape[1]] = g
            flat, full = cols.reshape(-1, CHANNELS), full.reshape(-1, self.FILTERS)[: 1 - self.WIDTH]
            g_conv = np.concatenate([flat[k : k + len(full)].T @ full for k in range(self.WIDTH)])
            grads = (g_conv + 1e-4 * self.conv, g.sum((0, 1)), g_out + 1e-4 * self.out)
            for p, (m, v), q in zip((self.conv, self.bias, self.out), state, grads, strict=True):
                m += 0.1 * (q - m)
                v += 0.01 * (q * q - v)
                p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def numbers(self) -> np.ndarray:
        """All that is learned by steps, as one row."""
        return np.concatenate([p.ravel() for p in (self.conv, self.bias, self.out)])

    @classmethod
    def of(cls, numbers: np.ndarray) -> Network:
        n = cls.WIDTH * CHANNELS * cls.FILTERS
        conv, bias, out = np.split(numbers.astype(np.float32), [n, n + cls.FILTERS])
        return cls(conv.reshape(-1, cls.FILTERS), bias, out)


def _candidates(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the candidates of all texts, and the text of each."""
    start, end = _runs(_IS_VALUE[texts.data], texts.off, LEAST)
    while True:  # marks at the end belong to the sentence
        trim = (end > start) & np.isin(texts.data[np.maximum(end - 1, 0)], [ord(c) for c in ".-=_/+"]) if len(end) else np.zeros(0, bool)
        if not trim.any():
            break
        end = end - trim
    keep = end - start >= LEAST if len(end) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(texts.off, start, "right") - 1


def _slides(texts: K.Texts, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows until the candidate and ``BEFORE`` bytes behind it are read, and the candidate of each."""
    until = np.minimum(end + BEFORE, texts.off[doc + 1])
    n = 1 + np.maximum(0, -(-(until - start - AFTER) // STEP))
    which = np.repeat(np.arange(len(start)), n)
    return start[which] + STEP * (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)), which


def _codes(texts: K.Texts, place: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The windows at those places as codes; before a text are line ends, behind it nothing."""
    at = place[:, None] + np.arange(-BEFORE, AFTER)
    code = texts.data[np.clip(at, 0, len(texts.data) - 1)].astype(np.int64)
    code[at < texts.off[doc][:, None]] = ord("\n")
    code[at >= texts.off[doc + 1][:, None]] = 512
    code[(at >= start[:, None]) & (at < end[:, None])] += 256
    return code


@dataclass
class Found:
    """Of one text: its number, base spans, its candidates' numbers, places in code points, and whether a base span overlaps them."""

    doc: int
    base: list
    mine: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    known: np.ndarray


def _merged(spans: list) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans that are in order of start."""
    out: list[list[int]] = []
    for _, s, e, *_ in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _overlapped(lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which ranges overlap one of the apart, ordered ranges start:end."""
    if not len(start):
        return np.zeros(len(lo), bool)
    k = np.searchsorted(end, lo, "right")
    return (k < len(start)) & (start[np.minimum(k, len(start) - 1)] < hi)


def _chars(texts: K.Texts, d: int) -> np.ndarray:
    """How many code points begin before each byte of text d."""
    data = texts.data[texts.off[d] : texts.off[d + 1]]
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _scan(texts: K.Texts, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> Iterator[Found]:
    """Every text that has base spans or candidates (``_candidates``' ranges)."""
    hs, _ = _runs(_IS_HEX[texts.data], texts.off, 32)
    hex_docs = set((np.searchsorted(texts.off, hs, "right") - 1).tolist())
    has = np.zeros(len(texts), bool)
    has[doc] = True
    has[list(hex_docs)] = True
    # a short assigned value is no candidate: = and : are rare enough to look at each text that has one
    marks = np.flatnonzero((texts.data == ord("=")) | (texts.data == ord(":")))
    has[np.searchsorted(texts.off, marks, "right") - 1] = True
    # nor is an access key that marks cut
    data = texts.data
    keys = np.flatnonzero((data[:-3] == ord("A")) & (data[1:-2] == ord("K")) & (data[2:-1] == ord("I")) & (data[3:] == ord("A"))) if len(data) > 3 else marks[:0]
    has[np.searchsorted(texts.off, keys, "right") - 1] = True
    for d in np.flatnonzero(has).tolist():
        base = base_spans(texts.column[d].as_py(), d in hex_docs)
        mine = np.arange(int(np.searchsorted(doc, d)), int(np.searchsorted(doc, d, "right")))
        lo = hi = mine
        if len(mine):
            chars, first = _chars(texts, d), int(texts.off[d])
            lo, hi = chars[start[mine] - first], chars[end[mine] - first]
        yield Found(d, base, mine, lo, hi, _overlapped(lo, hi, *_merged(base)))


_WINDOW = np.dtype(("<i2", (BEFORE + AFTER,)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows with labels. A task may tell one again that it has forgotten, others may tell the same."""
    seen: set[tuple[bool, int]] = set()
    for b in batches:
        texts = K.Texts(b.column("text"))
        start, end, doc = _candidates(texts)
        if not len(start):
            continue
        # bytes of the base spans that make a candidate known, as wide as the candidate at most
        label = np.zeros(len(start), bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for f in _scan(texts, start, end, doc):
            label[f.mine] = f.known
            if f.known.any():
                chars, first = _chars(texts, f.doc), int(texts.off[f.doc])
                s, e = _merged(f.base)
                parts.append((first + np.searchsorted(chars[1:], s, "right"), first + np.searchsorted(chars[1:], e, "right")))
        place, which = _slides(texts, start, end, doc)
        secret = label[which]
        if parts:
            s, e = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            # a long candidate's windows beside its finding are of neither label
            secret &= _overlapped(place, np.minimum(place + AFTER, end[which]), s, e)
        use = np.flatnonzero(secret | ~label[which])
        for lo in range(0, len(use), 2048):
            w = use[lo : lo + 2048]
            c = which[w]
            told: tuple[list, list, list] = ([], [], [])
            for row, y in zip(_codes(texts, place[w], start[c], end[c], doc[c]).astype("<i2"), secret[w].tolist(), strict=True):
                raw = row.tobytes()
                h = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                if (y, h) not in seen:
                    seen.add((y, h))
                    for column, x in zip(told, (int(y), h, raw), strict=True):
                        column.append(x)
            if len(seen) > REMEMBERED:
                seen.clear()
            if told[0]:
                h = np.array(told[1])
                split = np.searchsorted([5, 7], h % 8, "right")  # to learn from, to calibrate with, for the threshold
                yield pa.RecordBatch.from_arrays([pa.array((h >> 3) % BUCKETS, pa.int32()), pa.array(told[0], pa.int32()), pa.array(split, pa.int32()), pa.array(h), pa.array(told[2], pa.binary())], ["bucket", "label", "split", "hash", "codes"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of bucket, label, split and hash, each once, many in a row."""
    at: tuple | None = None
    last, held = None, []

    def row() -> pa.RecordBatch:
        packed = pa.compress(b"".join(held), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (*at, len(held))), pa.array([packed], pa.binary())], ["bucket", "label", "split", "n", "windows"])

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("bucket", "label", "split", "hash", "codes")]
        for *place, h, raw in zip(*columns, strict=True):
            if (*place,) != at:
                if held:
                    yield row()
                at, last, held = (*place,), None, []
            if h != last:
                held.append(raw)
                last = h
    if held:
        yield row()


def windows(docs: DataFrame) -> DataFrame:
    """All distinct windows of both labels (1: of a base finding), packed: bucket, label, split, n, windows."""
    spark = docs.sparkSession
    every = map_arrow(documents(docs), _windows, "bucket int, label int, split int, hash long, codes binary")
    ordered = every.repartition("bucket").sortWithinPartitions("bucket", "label", "split", "hash")
    folder = scratch(spark, "windows")
    ordered.mapInArrow(_packed, "bucket int, label int, split int, n int, windows binary").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def _unpacked(rows: list[dict]) -> np.ndarray:
    """The windows of some rows of ``_packed``, one behind the other."""
    parts = [np.frombuffer(pa.decompress(r["windows"], r["n"] * _WINDOW.itemsize, codec="zstd", asbytes=True), _WINDOW) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, _WINDOW)


def _marks(z: np.ndarray) -> np.ndarray:
    """Logits in whole steps, rounded down."""
    return np.floor(np.asarray(z, float) * STEPS_OF_ONE).astype(np.int64)


def _likeness(net: Network, code: np.ndarray) -> np.ndarray:
    """Marks of windows as they stand or blanked, the lower."""
    return np.minimum(_marks(net.logits(code)), _marks(net.logits(blanked(code))))


def _rest(code: np.ndarray, clean: tuple[Network, float] | None) -> np.ndarray:
    """Those windows that don't stand out; those that do as they stand are asked again, blanked."""
    if clean is None:
        return code
    net, cut = clean
    out = _marks(net.logits(code)) >= cut
    out[out] = _marks(net.logits(blanked(code[out]))) >= cut
    return code[~out]


def _quantile(counts: dict[int, int], q: float) -> int:
    """The mark that a share ``q`` of all, rounded down, is below."""
    marks = sorted(counts)
    upto = np.cumsum([counts[m] for m in marks])
    return marks[int(np.searchsorted(upto, min(int(q * upto[-1] + 1e-9), upto[-1] - 1), "right"))]


def _counts(shares: DataFrame, of: Callable[[int, int, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, dict[int, int]]:
    """How often each mark is there, of the kinds that ``of(label, split, codes)`` yields with marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for kind, marks in of(r["label"], r["split"], _unpacked([r])):
                    m, n = np.unique(marks, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), kind), pa.int32()), pa.array(m), pa.array(n)], ["kind", "mark", "n"])

    out: dict[int, dict[int, int]] = {}
    for r in shares.mapInArrow(run, "kind int, mark long, n long").groupBy("kind", "mark").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["kind"], {})[r["mark"]] = r["n"]
    return out


def _trained(shares: DataFrame, count: int, net: Network, learn: tuple, clean: tuple[Network, float] | None, common: dict[int, np.ndarray], seed: tuple) -> Network:
    """The network after all windows to learn from; ``common``: of a label that all shares have."""
    turns = MEETINGS if count > 1 else 1
    for turn in range(turns):
        numbers = net.numbers()

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, numbers: np.ndarray = numbers) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[list, list]] = {}
            for b in batches:
                for r in b.to_pylist():
                    held.setdefault(r["shard"], ([], []))[r["label"]].append(r)
            for shard, rows in sorted(held.items()):
                windows = [common[k] if k in common else _unpacked(sorted(rows[k], key=lambda r: (r["bucket"], r["split"]))) for k in (0, 1)]
                plain, secret = (w[turn::turns] for w in windows)
                own = Network.of(numbers)
                rest = _rest(plain, clean)
                own.train((rest, secret), np.random.default_rng((*seed, turn, shard)), -(-LEAST_STEPS // turns))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(rest) + len(secret)]), pa.array([own.numbers().tobytes()], pa.binary())], ["shard", "n", "numbers"])

        told = shares.where(F.col("split").isin(*learn)).mapInArrow(run, "shard long, n long, numbers binary").collect()
        told = sorted((r["shard"], r["n"], r["numbers"]) for r in told)
        net = Network.of(np.average([np.frombuffer(x, np.float32) for *_, x in told], 0, [max(1, n) for _, n, _ in told]))
    return net


def fit(docs: DataFrame, recall: float = RECALL, seed: int = 5) -> Network:
    """Train, calibrate and cut off on all windows of all documents, each for one of the three (``windows``' split)."""
    packed = windows(docs)
    size = {(r["label"], r["split"]): r["n"] for r in packed.groupBy("label", "split").agg(F.sum("n").alias("n")).collect()}
    of = lambda label, splits: sum(size.get((label, s), 0) for s in splits)
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    everything = (0, 1, 2)
    if min(of(k, everything) for k in (0, 1)) < LEAST_LEARNED:
        return net
    learn, curve, check = (0,), (1,), (2,)
    if min(of(k, s) for s in (learn, curve, check) for k in (0, 1)) < LEAST_LEARNED:
        learn = curve = check = everything
    count = int(max(1, min(BUCKETS, (of(0, learn) + of(1, learn)) // SHARE)))
    shares = settle(packed.withColumn("shard", F.expr(f"cast(bucket * {count} div {BUCKETS} as int)")).repartitionById(count, F.col("shard")))
    rare = [k for k in (0, 1) if count > 1 and of(k, learn) < FEW * count]
    common = {k: _unpacked([r.asDict() for r in packed.where((F.col("label") == k) & F.col("split").isin(*learn)).orderBy("bucket", "split").collect()]) for k in rare}

    def likeness(net: Network) -> Callable:
        # kind: label, and 2 for windows to calibrate with
        return lambda label, split, code: [(label + 2 * k, _likeness(net, code)) for k, part in ((0, learn), (1, curve)) if split in part and (k, label) != (1, 1)]

    clean = None
    for rounds in range(ROUNDS + 1):
        net = _trained(shares, count, Network.new(rng), learn, clean, common, (seed, rounds))
        if rounds < ROUNDS:  # unlabelled windows that stand out from the others towards the secrets aren't clean ones
            counts = _counts(shares, likeness(net))
            usual, most, secret = _quantile(counts[0], 1 - 2 * LEFT_OUT), _quantile(counts[0], 1 - LEFT_OUT), _quantile(counts[1], 0.1)
            cut = max(most, usual + STANDS_OUT * (secret - usual))
            if min(sum(n for m, n in counts.get(k, {}).items() if m < cut) for k in (0, 2)) >= LEAST_LEARNED:
                clean = net, cut

    def ends(label: int, split: int, code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if split in curve:
            yield label, _marks(net.logits(code if label else _rest(code, clean)))
        if label and split in check:
            yield 2, np.concatenate([_marks(net.logits(code)), _marks(net.logits(blanked(code)))])

    counts = _counts(shares, ends)
    from .toxicity import _logistic

    marks = [(m, k, n) for k in (0, 1) for m, n in sorted(counts[k].items())]
    x, y, weight = (np.array(c, float) for c in zip(*marks, strict=True))
    net.scale, net.shift = _logistic(x / STEPS_OF_ONE, y, weight)
    net.threshold = float(net._calibrated(_quantile(counts[2], 1 - recall) / STEPS_OF_ONE))
    return net


def blanked(code: np.ndarray) -> np.ndarray:
    """Windows with nothing around their candidates."""
    return np.where((code >= 256) & (code < 512), code, 512)


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, all spans, and the network's probability of each (1 for base spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = K.Texts(b.column("text"))
            spans: list[list] = [[] for _ in range(len(texts))]
            worth: list[list] = [[] for _ in range(len(texts))]
            for d, both in find(texts, net):
                spans[d] = [{"kind": k, "start": s, "end": e} for k, s, e, _ in both]
                worth[d] = [q for *_, q in both]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind), pa.array(worth, pa.list_(pa.float64()))], ["doc_id", "spans", "scores"])

    return map_arrow(documents(docs), run, SCANNED)


def find(texts: K.Texts, net: Network) -> Iterator[tuple[int, list[tuple[str, int, int, float]]]]:
    """Of each text that has some: its number and its spans with their probabilities."""
    start, end, doc = _candidates(texts)
    every = list(_scan(texts, start, end, doc))
    ask = np.concatenate([f.mine[~f.known] for f in every]) if every else np.zeros(0, np.int64)
    best = np.zeros(len(start))
    if len(ask) and net.threshold <= 1:
        place, which = _slides(texts, start[ask], end[ask], doc[ask])
        which = ask[which]
        for lo in range(0, len(which), 2048):
            w = which[lo : lo + 2048]
            np.maximum.at(best, w, net.scores(_codes(texts, place[lo : lo + 2048], start[w], end[w], doc[w])))
    for f in every:
        spans = [(*s, 1.0) for s in f.base]
        new = np.flatnonzero(~f.known & (best[f.mine] >= net.threshold))
        spans += [("model", int(f.lo[i]), int(f.hi[i]), float(best[f.mine[i]])) for i in new.tolist()]
        if spans:
            yield f.doc, in_order(spans)


def redact(docs: DataFrame, net: Network, mark: str = "[secret]") -> DataFrame:
    """All documents and columns; spans of ``text`` replaced by ``mark``, and ``n_chars`` (where there is one) counted anew in those texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = K.Texts(b.column("text"))
            text, count = b.column("text").to_pylist(), b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
            for d, spans in find(texts, net):
                out, at = [], 0
                for _, s, e, _ in spans:
                    if e > at:
                        if s >= at:
                            out += [text[d][at:s], mark]
                        at = e
                text[d] = "".join(out) + text[d][at:]
                if count:
                    count[d] = len(text[d])
            cols = {"text": text} | ({"n_chars": count} if count else {})
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], b.schema.field(n).type) if n in cols else b.column(n) for n in b.schema.names], b.schema.names)

    return map_arrow(docs, run, docs.schema)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    from .runtime import table

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "model")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("model").alias("n_model"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets redacted."""
    return redact(docs, fit(docs))
