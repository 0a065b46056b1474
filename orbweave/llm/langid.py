"""Language spans: script ranges, word scores and Viterbi with a switching penalty.

A word's script, read off the ranges of its letters, leaves the languages that
write in it; those get the word's naive-Bayes score over hashed byte n-grams.
Along a document the best sequence of languages is found where each change
costs ``SWITCH``; runs of one language are its spans. A document's language is
that of most letters.

Defined results: ``und`` with score 0 where a text is null, empty or has no
letter, or nothing could be learned. Equal shares go to the language first in
order. Repeated rows are labelled alike, each. Rows with null lang aren't
learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import crc_order, documents, fold, map_arrow

#: Documents learned from for each language, at most.
PER_LANGUAGE = 1_500
SIZES, BUCKETS = range(2, 5), 1 << 15
#: Cost of a change of language, in units of the tempered scores; how much of overlapping n-grams' evidence counts.
SWITCH, TEMPER = 8.0, 0.4
#: Scores (words times languages) decoded at once, and kept of distinct words.
GROUP_SCORES, KEPT_SCORES = 1 << 23, 1 << 23
LABELLED = "doc_id long, lang_pred string, score double, n_spans int, spans array<struct<start:int,end:int,lang:string>>"


def _scripts() -> tuple[np.ndarray, np.ndarray]:
    """Script numbers by a letter's first UTF-8 byte, and how far the second one splits them; 0 is no letter.

    1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 8 kana, 9 Han,
    10 Hangul; from 16 the blocks of U+0800 (Devanagari to Lao, 128 code points
    each), from 48 those of U+1000.
    """
    first, second = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for lo, hi, script in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCB, 1), (0xCD, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD5, 4), (0xD6, 0xD7, 5), (0xD8, 0xDF, 6), (0xE0, 0xE0, 16), (0xE1, 0xE1, 48), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10)):
        first[lo : hi + 1] = script
    second[0xE0] = second[0xE1] = 1
    return first, second


_FIRST, _SECOND = _scripts()


def word_scripts(p: K.Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Script of each word (the highest of its letters'), and its number of letters."""
    if not len(p):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    data = p.texts.data
    script = _FIRST[data]
    wide = np.flatnonzero(_SECOND[data])
    if len(wide):
        script[wide] += (data[np.minimum(wide + 1, len(data) - 1)] & 0x3F) >> 1
    edges = np.empty(2 * len(p), np.int64)
    edges[0::2], edges[1::2] = p.start, p.end
    cut = edges[:-1] if edges[-1] == len(data) else edges
    return np.maximum.reduceat(script, cut)[0::2], np.add.reduceat((script > 0).astype(np.int32), cut)[0::2].astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order; log-likelihoods by bucket; for each script a row of which languages use it."""

    languages: list[str]
    table: np.ndarray
    uses: np.ndarray


def _buckets(g: np.ndarray) -> np.ndarray:
    return (g % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from at most ``per_language`` documents of each value of lang; the model takes 128 kB for each value.

    Which ones is told from ids and lang alone, in a fixed pseudo-random order;
    only those ids and one count for each language are broadcast.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    common = known.groupBy("lang").count().withColumnRenamed("count", "_n")
    order = Window.partitionBy("lang").orderBy(crc_order("doc_id"), "doc_id")
    # about 1.2 times the wanted number by a threshold on hashes, so that no window holds more of a frequent language
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < F.lit(1.2e6 * per_language) / F.col("_n")
    chosen = known.join(F.broadcast(common), "lang").where(share).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("doc_id", F.col("lang").alias("learn")).distinct()
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").select("text", "learn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang in b.column("learn").unique().to_pylist():
                p = K.words(b.filter(pc.equal(b.column("learn"), lang)).column("text"))
                if not len(p):
                    continue
                # buckets, then letters by script
                mine = total.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))
                script, letters = word_scripts(p)
                mine[BUCKETS:] += np.bincount(script, weights=letters, minlength=256).astype(np.int64)
                _, rep, times = np.unique(p.hash, return_index=True, return_counts=True)
                for i in range(0, len(rep), 1 << 16):
                    g, owner = K.grams(p, rep[i : i + (1 << 16)], SIZES)
                    mine[:BUCKETS] += np.bincount(_buckets(g), weights=times[i + owner], minlength=BUCKETS).astype(np.int64)
        for lang, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(x[at])], ["learn", "at", "n"])

    sums = map_arrow(rows, count, "learn string, at long, n long").groupBy("learn", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums.learn.unique().tolist())
    counts = np.zeros((BUCKETS + 256, len(names)))
    if names:
        counts[sums["at"].to_numpy(), np.searchsorted(names, sums.learn.to_numpy().astype(str))] = sums.n.to_numpy()
    grams, letters = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    table = (np.log(grams / grams.sum(0)) * TEMPER).astype(np.float32) if names else np.zeros((BUCKETS, 0), np.float32)
    uses = letters >= 0.01 * np.maximum(letters[1:].sum(0), 1)
    uses[0] = True
    return LanguageModel(names, table, uses)


class WordScores:
    """Scores of words by language, each distinct word's computed once while the bounded cache holds it."""

    def __init__(self, m: LanguageModel, most: int = KEPT_SCORES):
        self.m, self.most, self.used = m, max(1 << 12, most // max(1, len(m.languages))), 0
        self.cache = K.HashCache(20)
        self.rows = np.zeros((1 << 12, len(m.languages)), np.float32)

    def __call__(self, p: K.Pieces, script: np.ndarray) -> np.ndarray:
        if self.used > self.most:
            self.cache.clear()
            self.used = 0
        known, at = self.cache.find(p.hash)
        miss = np.flatnonzero(~known)
        if len(miss):
            fresh, back = np.unique(p.hash[miss], return_index=True)
            rep = miss[back]
            while self.used + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            size = max(256, (1 << 17) // max(1, len(self.m.languages)))
            for i in range(0, len(rep), size):
                part = rep[i : i + size]
                g, owner = K.grams(p, part, SIZES)
                order = np.argsort(owner, kind="stable")
                score = np.add.reduceat(self.m.table[_buckets(g)[order]], np.searchsorted(owner[order], np.arange(len(part))), axis=0)
                able = self.m.uses[script[part]]
                able |= ~able.any(1)[:, None]
                score = np.where(able, score, score.min() - 50)
                score -= score.max(1)[:, None]
                score[script[part] == 0] = 0
                self.rows[self.used + i : self.used + i + len(part)] = score
            new = self.used + np.arange(len(fresh))
            self.used += len(fresh)
            at = at.copy()
            at[miss] = new[np.searchsorted(fresh, p.hash[miss])]
            self.cache.put(fresh, new)
        return self.rows[at]


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; document i has words first[i]:first[i + 1]. All documents advance together, word by word."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    alive = np.searchsorted(-n[order], -np.arange(1, (n.max() if len(n) else 0) + 1), "right")
    head = first[:-1][order]
    total = np.zeros((len(n), score.shape[1]))
    every = np.arange(len(n))
    kind = np.min_scalar_type(max(score.shape[1] - 1, 0))
    steps = []
    for t, k in enumerate(alive.tolist()):
        s, v = score[head[:k] + t], total[:k]
        if t:
            best = v.argmax(1)
            top = (v[every[:k], best] - switch)[:, None]
            steps.append((best.astype(kind), v >= top))
            v = np.maximum(v, top)
        total[:k] = v + s
    out = np.zeros(len(score), kind)
    label = total.argmax(1).astype(kind)
    for t in range(len(alive) - 1, -1, -1):
        k = int(alive[t])
        out[head[:k] + t] = label[:k]
        if t:
            best, stay = steps[t - 1]
            label[:k] = np.where(stay[every[:k], label[:k]], label[:k], best)
    return out


def predict(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score (the share of letters in its spans) and the spans (code points, end exclusive)."""
    names = model.languages

    def finish(held: list, scores: WordScores) -> Iterator[pa.RecordBatch]:
        script_of = [word_scripts(p) for _, p, _ in held]
        score = np.concatenate([scores(p, s) for (_, p, _), (s, _) in zip(held, script_of, strict=True)])
        first, at = [np.zeros(1, np.int64)], 0
        for _, p, _ in held:
            first.append(p.first[1:] + at)
            at += len(p)
        label_all = viterbi(score, np.concatenate(first), switch)
        at = 0
        for (ids, p, told), (_, letters) in zip(held, script_of, strict=True):
            label, n = label_all[at : at + len(p)], len(ids)
            at += len(p)
            doc = p.doc()
            share = np.bincount(doc * len(names) + label.astype(np.int64), weights=letters, minlength=n * len(names)).reshape(n, len(names))
            total = share.sum(1)
            best = share.argmax(1)
            # letters of scripts beyond the ranges tell nothing: the first language, at its even share
            worth = np.where(told, np.where(total > 0, share.max(1) / np.maximum(total, 1), 1 / len(names)), 0.0)
            # spans: runs of a label over the words that have letters
            real = np.flatnonzero(letters > 0)
            d, lab = doc[real], label[real]
            new = np.ones(len(real), bool)
            new[1:] = (d[1:] != d[:-1]) | (lab[1:] != lab[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(real)) - 1 if len(head) else head
            chars = np.concatenate([[0], np.cumsum((p.texts.data & 0xC0) != 0x80)])
            base = chars[p.texts.off[:-1]]
            begin = chars[p.start[real[head]]] - base[d[head]] if len(head) else head
            end = chars[p.end[real[tail]]] - base[d[head]] if len(head) else head
            count = np.bincount(d[head], minlength=n) if len(head) else np.zeros(n, np.int64)
            item = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array([names[x] for x in lab[head].tolist()], pa.string())], ["start", "end", "lang"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), item)
            yield pa.RecordBatch.from_arrays([ids, pa.array([names[x] if ok else "und" for x, ok in zip(best.tolist(), told.tolist(), strict=True)]), pa.array(worth), pa.array(count, pa.int32()), spans], ["doc_id", "lang_pred", "score", "n_spans", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model)
        held, n = [], 0
        for b in batches:
            p = K.words(b.column("text"))
            if not names:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(["und"] * b.num_rows), pa.array(np.zeros(b.num_rows)), pa.array(np.zeros(b.num_rows), pa.int32()), pa.array([[]] * b.num_rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))], ["doc_id", "lang_pred", "score", "n_spans", "spans"])
                continue
            held.append((b.column("doc_id"), p, pc.match_substring_regex(p.texts.column, r"\pL").to_numpy(zero_copy_only=False)))
            n += len(p)
            if n * len(names) >= GROUP_SCORES:
                yield from finish(held, scores)
                held, n = [], 0
        if held:
            yield from finish(held, scores)

    return map_arrow(documents(docs), run, LABELLED)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from those whose fold of four isn't 2."""
    from .runtime import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_spans", "spans")
