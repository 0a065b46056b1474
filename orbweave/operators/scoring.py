"""Rarity: the mean distance of each trajectory to its nearest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.pairwise import over_block_pairs, shape

YEAR, SEASON = 365, 15


def nearest(vec: DataFrame, length: int, most: int, apart: int, season: int | None = None) -> DataFrame:
    """(i, j, d, r): the ``most`` nearest trajectories of each, at least ``apart`` steps off; r counts from 1 by (d, j).

    With ``season`` only starts whose places in a 365-step year are within that
    many steps, around the year's end too. Each pair of super-blocks gives its own
    best few, so what is shuffled is ``most`` rows for each start and super-block.
    """

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.abs(i[:, None] - j[None]) >= apart
        if season is not None:
            gap = np.abs(i[:, None] % YEAR - j[None] % YEAR)
            ok &= np.minimum(gap, YEAR - gap) <= season
        return ok

    def merge(own: np.ndarray, other: np.ndarray, dist: np.ndarray, held: dict) -> None:
        """Put what is among the ``most`` nearest so far of the starts ``own``."""
        at = int(own[0])
        d, j = held.get(at, (np.full((len(own), most), np.inf), np.full((len(own), most), -1)))
        last = d[:, -1]
        if dist.shape[1] > most and not np.isfinite(last).all():  # a bound of the tile itself, until there is one of those before
            last = np.minimum(last, np.partition(dist, most - 1, axis=1)[:, most - 1])
        row, col = np.nonzero((dist <= last[:, None]) & (dist < np.inf))
        if not len(row):
            held[at] = d, j
            return
        hit = np.unique(row)
        row = np.concatenate([np.repeat(hit, most), row])
        every, name = np.concatenate([d[hit].ravel(), dist[row[len(hit) * most :], col]]), np.concatenate([j[hit].ravel(), other[col]])
        order = np.lexsort((name, every, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < most
        d[row[keep], rank[keep]], j[row[keep], rank[keep]] = every[order][keep], name[order][keep]
        held[at] = d, j

    def kernel(i0: int, j0: int, dist: np.ndarray, held: dict) -> None:
        i, j = i0 + np.arange(dist.shape[0]), j0 + np.arange(dist.shape[1])
        if season is not None or j0 - i[-1] < apart:
            dist = np.where(allowed(i, j), dist, np.inf)
        merge(i, j, dist, held)
        if i0 != j0:
            merge(j, i, dist.T, held)

    def end(held: dict) -> Iterator[pa.RecordBatch]:
        for at, (d, j) in held.items():
            ok = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(at + np.arange(len(d))[:, None], d.shape)[ok]), pa.array(j[ok]), pa.array(d[ok])], ["i", "j", "d"])

    found = over_block_pairs(vec, length, kernel, "i long, j long, d double", end)
    w = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)


def _starts(vec: DataFrame, length: int) -> DataFrame:
    return vec.sparkSession.range(max(0, shape(vec)[0] - length + 1)).select(F.col("id").alias("t"))


def score_base(vec: DataFrame, length: int = 5, k: int = 10, apart: int = -1) -> DataFrame:
    """(t, score): mean squared distance of the k nearest trajectories at least ``apart`` (-1: length) steps off.

    Every start has a row; the score is null where no neighbour has a distance, as with a missing component.
    """
    apart = length if apart == -1 else apart
    scores = nearest(vec, length, k, apart).groupBy(F.col("i").alias("t")).agg(F.avg("d").alias("score"))
    return _starts(vec, length).join(scores, "t", "left").select("t", "score")


def score_exclusion(vec: DataFrame, length: int = 5, k: int = 10, apart: int = -1, compat: bool = False) -> DataFrame:
    """(t, score, n): as ``score_base``, but the neighbours also keep ``apart`` from each other, taken greedily from the k * apart nearest.

    Every start has a row; without a neighbour the score is null and n 0.
    ``compat``: trajectory 0 takes its k nearest others without either rule.
    """
    apart = length if apart == -1 else apart
    if apart < 1:
        raise ValueError("apart must be 1 at least")
    pool = nearest(vec, length, k * apart, apart).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("pool"))
    free = lambda got, p: (F.size(got) < k) & ~F.exists(got, lambda g: F.abs(g["j"] - p["j"]) < apart)
    taken = F.aggregate("pool", F.array().cast("array<struct<d:double,j:bigint>>"), lambda got, p: F.when(free(got, p), F.concat(got, F.array(p))).otherwise(got))
    scores = pool.select(F.col("i").alias("t"), taken.alias("g")).select("t", (F.aggregate("g", F.lit(0.0), lambda s, g: s + g["d"]) / F.size("g")).alias("score"), F.size("g").cast("long").alias("n"))
    if compat:
        first = nearest(vec, length, k, 1).where("i = 0").groupBy(F.col("i").alias("t")).agg(F.avg("d").alias("score"), F.count("*").alias("n"))
        scores = scores.where("t <> 0").unionByName(first)
    return _starts(vec, length).join(scores, "t", "left").select("t", "score", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def score_interval(vec: DataFrame, length: int = 5, k: int = 10, apart: int = -1, season: int = SEASON, compat: bool = False) -> DataFrame:
    """(t, score, n): neighbours of the same season only; of fewer than k, their mean; of none, null.

    ``compat``: trajectory 0 isn't held to the season.
    """
    apart = length if apart == -1 else apart
    mean = lambda near: near.groupBy(F.col("i").alias("t")).agg(F.avg("d").alias("score"), F.count("*").alias("n"))
    scores = mean(nearest(vec, length, k, apart, season))
    if compat:
        scores = scores.where("t <> 0").unionByName(mean(nearest(vec, length, k, apart).where("i = 0")))
    return _starts(vec, length).join(scores, "t", "left").select("t", "score", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exact_knn(vec: DataFrame, k: int = 10) -> DataFrame:
    """(t, score): mean distance (rooted) of the k nearest other steps."""
    return nearest(vec, 1, k, 1).groupBy(F.col("i").alias("t")).agg(F.avg(F.sqrt("d")).alias("score"))


def score_pca(vec: DataFrame, length: int = 5, k: int = 10, apart: int = -1, share: float = 0.95, rank: int = 100) -> DataFrame:
    """``score_base`` on the fewest of the first ``rank`` principal components that hold ``share`` of their variance."""
    from orbweave.operators.cluster import pca_project

    projected, _ = pca_project(vec, share=share, rank=rank, of_rank=True)
    return score_base(projected, length, k, apart)


VARIANTS = {"base": score_base, "exclusion": score_exclusion, "interval": score_interval}


def score(vec: DataFrame, algorithm: str = "base", **options) -> DataFrame:
    """By the variant's name."""
    return VARIANTS[algorithm](vec, **options)


def knn_scores(field: DataFrame, algorithm: str = "base", weigh: bool | None = None, lat: tuple | None = None, lon: tuple | None = None, years: tuple[int, int] | None = None, **options) -> DataFrame:
    """Scores of a field: slices, weighting by latitude (base only, unless told), missing cells dropped (interval), then the variant."""
    from orbweave.operators import preprocess as P

    if years is not None:
        field = P.dense_steps(P.slice_time(field, f"{years[0]}-01-01", f"{years[1]}-12-31"))
    field = P.crop_space(field, lat, lon)
    if algorithm == "interval":
        field = P.drop_nan_cells(field)
    if algorithm == "base" if weigh is None else weigh:
        field = P.coslat_weight(field)
    vec = P.to_vectors(field)
    return score(vec, algorithm, **options).join(vec.select("t", "time"), "t")
