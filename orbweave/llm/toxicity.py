"""Toxicity by maximum-scoring segments of token log-odds.

Byte n-grams of words (three to six, ends marked) get log-odds between toxic and
other labelled documents under an informative Dirichlet prior (the n-gram's share
in both, and a floor), so that inflected and compound words count too; a word's
score is that of its highest n-gram. Words without one clearly over zero cost a
small penalty, so a random text drifts downwards and its best segment stays short. A linear scan finds all
maximal scoring segments of a document; their scores are made comparable over
lengths with the extreme-value law of best segments, summed, and turned into a
probability with a logistic curve. The law and the curve are fitted on labelled
documents that the log-odds weren't learned from, the curve on the same sums
that scores are made of.

Defined results: a null or empty text, or one without a scored word, gets the
curve's value at no evidence. Repeated rows are scored alike, row by row. Labels
that are null, and labels of unknown documents, aren't learned from; with
several labels of a document the highest counts. Without any usable label every
score is 0. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import crc_order, documents, fold, map_arrow, settle

#: Bytes of the n-grams, and of how many words they are made at a time.
SIZES, GRAM_WORDS = range(3, 7), 1 << 16
#: One labelled document of so many is set apart for calibration, if that leaves so many of each label there.
CALIBRATE, LEAST_HELD = 4, 8
SCORED = "doc_id long, score double, n_passages int, passages array<struct<start:int,end:int,score:double>>"


@dataclass(frozen=True)
class ToxicModel:
    """hashes (sorted) and weights of the n-grams over zero; the penalty of others; Gumbel and logistic parameters."""

    hashes: np.ndarray
    weights: np.ndarray
    penalty: float
    scale: float
    location: float
    slope: float
    offset: float


def segments(position: np.ndarray, weight: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first word, last word, score).

    ``position`` and ``weight`` are of the words over zero, ascending; every
    other word costs ``penalty``. Linear: the stack of Ruzzo and Tompa's method,
    over the words above zero only, as no maximal segment begins or ends elsewhere.
    """
    stack: list[list[float]] = []  # first, last, sum before, sum with
    total, last = 0.0, -1
    for at, w in zip(position.tolist(), weight.tolist(), strict=True):
        total -= penalty * (at - last - 1)
        seg = [at, at, total, total + w]
        total, last = total + w, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j -= 1
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append(seg)
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in stack]


def _evidence(found: list[tuple[int, int, float]], n: int, m: ToxicModel) -> tuple[float, list]:
    """Sum over significant segments of their score beyond what the best of n random words reaches."""
    floor = m.location + m.scale * np.log(max(n, 1))
    kept = [(a, b, s) for a, b, s in found if s > floor]
    return sum((s - floor) / m.scale for _, _, s in kept), kept


def word_weights(p: K.Pieces, m: ToxicModel, cache: K.HashCache) -> np.ndarray:
    """Each word's log-odds: the most of its n-grams', 0 where none is in the model."""
    known, weight = cache.find(p.hash)
    if not known.all():
        miss = np.flatnonzero(~known)
        fresh, back = np.unique(p.hash[miss], return_index=True)
        rep = miss[back]
        new = np.zeros(len(fresh))
        for i in range(0, len(fresh), GRAM_WORDS):
            g, owner = K.grams(p, rep[i : i + GRAM_WORDS], SIZES)
            at = np.minimum(np.searchsorted(m.hashes, g), len(m.hashes) - 1)
            hit = m.hashes[at] == g
            np.maximum.at(new, owner[hit] + i, m.weights[at[hit]])
        weight = weight.copy()
        weight[miss] = new[np.searchsorted(fresh, p.hash[miss])]
        cache.put(fresh, new)
    return weight


def _scan(p: K.Pieces, m: ToxicModel, cache: K.HashCache) -> Iterator[tuple[int, int, list]]:
    """For each document with words over zero: its number, its words, its segments."""
    if not len(m.hashes) or not len(p):
        return
    weight = word_weights(p, m, cache)
    hit = np.flatnonzero(weight > 0)
    doc = np.searchsorted(p.first, hit, "right") - 1
    for d in np.unique(doc).tolist():
        mine = hit[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
        yield d, int(p.first[d + 1] - p.first[d]), segments(mine - p.first[d], weight[mine], m.penalty)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams and in how many documents with label 0 and 1 they are."""
    for b in batches:
        p, label = K.words(b.column("text")), b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        seen = []
        for d in range(b.num_rows):
            _, rep = np.unique(p.hash[p.first[d] : p.first[d + 1]], return_index=True)
            parts = [np.unique(K.grams(p, rep[i : i + GRAM_WORDS] + p.first[d], SIZES)[0]) for i in range(0, len(rep), GRAM_WORDS)]
            seen.append(parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
        every = np.concatenate(seen)
        ones = np.concatenate([x if y else x[:0] for x, y in zip(seen, label, strict=True)])
        keys, both = np.unique(every, return_counts=True)
        one = np.zeros(len(keys), np.int64)
        k1, n1 = np.unique(ones, return_counts=True)
        one[np.searchsorted(keys, k1)] = n1
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(both - one), pa.array(one)], ["h", "y0", "y1"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4_000, prior_share: float = 0.01, floor: float = 0.5, z_least: float = 3.5, w_least: float = 3.5) -> ToxicModel:
    """Learn from at most ``max_labelled`` documents of each label, taken in a fixed pseudo-random order.

    Only ids and labels are held against that bound; the texts are joined to
    them by broadcasting those at most 2 x ``max_labelled`` ids.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where("toxic = 0").orderBy(crc_order("doc_id"), "doc_id").limit(max_labelled).unionByName(known.where("toxic = 1").orderBy(crc_order("doc_id"), "doc_id").limit(max_labelled))
    # of equal texts one is learned from, so that a large group of copies doesn't make its words look common
    rows = settle(documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("apart", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(CALIBRATE)) == 0))
    learned = rows.where(~F.col("apart"))
    counted = map_arrow(learned, _counts, "h long, y0 long, y1 long").groupBy("h").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
    size = {(r["apart"], r["toxic"]): r["count"] for r in rows.groupBy("apart", "toxic").count().collect()}
    n0, n1 = size.get((False, 0), 0), size.get((False, 1), 0)
    none = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, 0.0, 0.0, -50.0)
    if not n0 or not n1:
        return none
    prior = prior_share * (n0 + n1)
    share = (F.col("y0") + F.col("y1")) / F.lit(float(n0 + n1))
    alpha = share * prior + floor
    odds = lambda y, n: F.log((F.col(y) + alpha) / (F.lit(n + prior + 2 * floor) - F.col(y) - alpha))
    scored = counted.where("y1 >= 3").select("h", (odds("y1", n1) - odds("y0", n0)).alias("w"), (1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha)).alias("v"))
    kept = scored.where((F.col("w") >= w_least) & (F.col("w") / F.sqrt("v") >= z_least)).collect()
    if not kept:
        return none
    h = np.array([r["h"] for r in kept], np.int64).view(np.uint64)
    w = np.array([r["w"] for r in kept])
    order = np.argsort(h)
    penalty = float(np.median(w)) / 40
    raw = ToxicModel(h[order], w[order], penalty, 1.0, 0.0, 1.0, 0.0)

    def evidence(m: ToxicModel, told: Callable) -> pd.DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = K.HashCache(20, np.float64)
            for b in batches:
                p = K.words(b.column("text"))
                x, n = np.zeros(b.num_rows), np.diff(p.first).astype(np.int64)
                for d, words, found in _scan(p, m, cache):
                    x[d] = told(found, words)
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x), pa.array(n)], ["toxic", "x", "n"])

        return map_arrow(held.select("toxic", "text"), run, "toxic int, x double, n long").toPandas()  # at most 2 x max_labelled small rows

    # too few set apart to calibrate on: all
    held = rows.where("apart") if min(size.get((True, 0), 0), size.get((True, 1), 0)) >= LEAST_HELD else rows
    seen = evidence(raw, lambda found, _: max(s for *_, s in found))
    clean = seen[seen.toxic == 0]
    # Gumbel by quartiles (mislabelled documents don't move it) over those that aren't toxic; a twelfth of one clear word is the least spread
    q1, q2, q3 = np.quantile(clean.x, [0.25, 0.5, 0.75]) if len(clean) else (0.0, 0.0, 0.0)
    scale = max(float(q3 - q1) / 1.5725, float(np.median(w)) / 12)
    location = max(0.0, float(q2 - scale * np.log(np.maximum(clean.n, 1)).median() + np.log(np.log(2)) * scale)) if len(clean) else 0.0
    m = ToxicModel(raw.hashes, raw.weights, penalty, scale, location, 1.0, 0.0)
    seen = evidence(m, lambda found, words: _evidence(found, words, m)[0])
    slope, offset = _logistic(seen.x.to_numpy(), seen.toxic.to_numpy().astype(float))
    return ToxicModel(m.hashes, m.weights, penalty, scale, location, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset by Newton steps, with Platt's smoothed targets and a small ridge. ``weight``: how often each is there, else once."""
    w = np.ones_like(x) if weight is None else weight
    n1, n0 = (w * y).sum(), (w * (1 - y)).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    b = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (w * (t - q)) - 1e-3 * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 0.0)), float(b[1])


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score from 0 to 1, and the significant passages (character offsets, end exclusive) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = K.HashCache(20, np.float64)
        for b in batches:
            p = K.words(b.column("text"))
            x, kept = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for d, n, found in _scan(p, model, cache):
                x[d], spans = _evidence(found, n, model)
                if spans:
                    base = p.first[d]
                    data = p.texts.data[p.texts.off[d] : p.texts.off[d + 1]]
                    chars = np.cumsum((data & 0xC0) != 0x80)  # code points up to each byte
                    for i, j, s in spans:
                        lo, hi = p.start[base + i] - p.texts.off[d], p.end[base + j] - p.texts.off[d]
                        kept[d].append({"start": int(chars[lo]) - 1, "end": int(chars[hi - 1]), "score": float(s)})
            q = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -50, 50))) if len(model.hashes) else np.zeros(b.num_rows)
            spans = pa.array(kept, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q), pa.array([len(k) for k in kept], pa.int32()), spans], ["doc_id", "score", "n_passages", "passages"])

    return map_arrow(documents(docs), run, SCORED)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from labels whose fold of five isn't 0."""
    from .runtime import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half, with their columns."""
    from .runtime import table

    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = K.HashCache(20, np.float64)
        for b in batches:
            p = K.words(b.column("text"))
            x = np.zeros(b.num_rows)
            for d, n, found in _scan(p, model, cache):
                x[d], _ = _evidence(found, n, model)
            yield b.filter(pa.array(model.slope * x + model.offset < 0)) if len(model.hashes) else b

    return map_arrow(docs, keep, docs.schema)
