"""Distances of steps and of trajectories.

The series is cut into super-blocks of neighbouring steps; each pair of them is one
task's, so a step is sent as many times as there are super-blocks, in one shuffle,
and no table of all T x T distances exists unless it is the result. In the task an
Arrow kernel makes the distances of a tile with a matrix product and sums them
along diagonals; scoring keeps the few best of each row within the kernel. Half of
the grid is computed, as distances are symmetric.

Vectors (t, x) must have each step from 0 to the last once, and x of one length:
anything else raises. NaN and null components make distances NaN, which no
neighbour search takes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a super-block, at most about, of an Arrow batch and of a tile's vectors; rows of a tile at least and at most.
SUPER_BYTES, BATCH_BYTES, TILE_BYTES, LEAST_ROWS, MOST_ROWS = 128 << 20, 8 << 20, 4 << 20, 16, 512
#: Vectors whose squared distance is below this share of their squared norms are subtracted: a product has lost their digits.
CLOSE = 1e-6


def sq_norms(vec: DataFrame) -> DataFrame:
    """(t, norm2): each vector's squared norm; null where a component is."""
    return vec.select("t", F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda a, v: a + v).alias("norm2"))


def shape(vec: DataFrame) -> tuple[int, int]:
    """Steps and components. Raises unless t is dense from 0, each step once, and all x are of one length."""
    size = F.coalesce(F.size("x"), F.lit(-1))
    r = vec.agg(F.count("*").alias("n"), F.count_distinct("t").alias("k"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.min(size).alias("short"), F.max(size).alias("d")).first()
    if not r["n"]:
        return 0, 0
    if r["lo"] != 0 or r["hi"] + 1 != r["n"] or r["k"] != r["n"]:
        raise ValueError(f"steps must be 0 to n - 1, each once: {r['n']} rows, {r['k']} steps from {r['lo']} to {r['hi']}")
    if r["short"] != r["d"] or r["d"] < 0:
        raise ValueError(f"vectors of {r['short']} to {r['d']} components")
    return r["n"], r["d"]


def small_batches(spark: SparkSession, d: int) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES`` of vectors of d components; never raises them."""
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", max(16, BATCH_BYTES // (8 * max(d, 1)))
    if not 0 < int(spark.conf.get(key, "10000")) <= most:
        spark.conf.set(key, str(most))


def tile_rows(d: int, steps: int) -> int:
    """Rows of a tile, by its bytes."""
    return int(max(LEAST_ROWS, min(MOST_ROWS, TILE_BYTES // (8 * max(d, 1)), -(-steps // 8))))


def super_blocks(n: int, d: int, cores: int) -> int:
    """How many super-blocks n starts make: small enough for a task, and some pairs for each core."""
    return max(1, min(n, max(-(-n * d * 8 // SUPER_BYTES), math.isqrt(4 * cores - 1) + 1)))


def traj_block(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """D of all starts in a and b: squared distances, never below 0, summed along diagonals."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    d = norms - 2 * (a @ b.T)
    i, j = np.nonzero(d < CLOSE * norms)
    some = max(1, TILE_BYTES // (8 * max(1, a.shape[1])))
    for lo in range(0, len(i), some):
        gap = a[i[lo : lo + some]] - b[j[lo : lo + some]]
        d[i[lo : lo + some], j[lo : lo + some]] = np.einsum("ij,ij->i", gap, gap)
    np.maximum(d, 0, out=d)
    n, m = max(0, len(a) - length + 1), max(0, len(b) - length + 1)
    out = d[:n, :m].copy()
    for o in range(1, length):
        out += d[o : o + n, o : o + m]
    return out


def over_block_pairs(vec: DataFrame, length: int, kernel: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """``kernel(i0, j0, D)`` of every pair of tiles, i0 <= j0, as rows of ``schema``; it yields record batches.

    With ``end`` a pair of super-blocks is summed up: the kernel has a dict, empty at first, as its last argument and
    yields nothing; ``end`` yields the batches of that dict.
    """
    spark = vec.sparkSession
    steps, d = shape(vec)
    n = max(0, steps - length + 1)
    rows = tile_rows(d, steps)
    g = super_blocks(n, d, spark.sparkContext.defaultParallelism)
    per = max(1, -(-n // (g * rows))) * rows  # starts of a super-block, whole tiles
    g = max(1, -(-n // per))
    # a step is in its own super-block and, up to length - 1 steps behind the end, in those before
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (per + length - 2)) / per)).cast("long")
    own = vec.select("t", "x", F.explode(F.sequence(first, F.least(F.expr(f"t div {per}"), F.lit(g - 1)))).alias("b"))
    ahead = F.transform(F.sequence(F.col("b"), F.lit(g - 1).cast("long")), lambda j: F.struct(F.col("b").alias("bi"), j.alias("bj"), F.lit(0).alias("side")))
    behind = F.transform(F.sequence(F.lit(0).cast("long"), F.col("b")), lambda i: F.struct(i.alias("bi"), F.col("b").alias("bj"), F.lit(1).alias("side")))
    # of a super-block with itself one copy is enough
    spots = F.filter(F.concat(ahead, behind), lambda z: (z["bi"] < z["bj"]) | (z["side"] == 0))
    dealt = own.select("t", "x", F.explode(spots).alias("z")).select("z.bi", "z.bj", "z.side", "t", "x")
    dealt = dealt.repartition(max(1, g * (g + 1) // 2), "bi", "bj").sortWithinPartitions("bi", "bj", "side", "t")

    def tiles(bi: int, bj: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for p in range(0, len(a) - length + 1, rows):
            i0 = bi * per + p
            for q in range(p if bi == bj else 0, len(b) - length + 1, rows):
                j0 = bj * per + q
                dist = traj_block(a[p : p + rows + length - 1], b[q : q + rows + length - 1], length)
                if end:
                    kernel(i0, j0, dist, held)
                else:
                    yield from kernel(i0, j0, dist)
        if end:
            yield from end(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: tuple[list, list] = ([], [])

        def told() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate(h) if h else None for h in held)
            yield from tiles(*at, a, a if b is None else b)

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bi", "bj", "side")], 1)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(place)), strict=True):
                pair = int(place[lo, 0]), int(place[lo, 1])
                if at is not None and pair != at:
                    yield from told()
                    held = ([], [])
                at = pair
                held[place[lo, 2]].append(x[lo:hi])
        if at is not None:
            yield from told()

    small_batches(spark, d)
    return dealt.mapInArrow(run, schema)


def traj_distance(vec: DataFrame, length: int, apart: int = 1) -> DataFrame:
    """(i, j, d): summed squared distance of the trajectories at i and j, for j - i >= apart. The result has N * N / 2 rows."""

    def kernel(i0: int, j0: int, dist: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero((j0 + np.arange(dist.shape[1]))[None] - (i0 + np.arange(dist.shape[0]))[:, None] >= apart)
        yield pa.RecordBatch.from_arrays([pa.array(i + i0), pa.array(j + j0), pa.array(dist[i, j])], ["i", "j", "d"])

    return over_block_pairs(vec, length, kernel, "i long, j long, d double")


def traj_totals(vec: DataFrame, length: int, apart: int = 1) -> DataFrame:
    """(i, total): the sum of ``traj_distance`` over each i's later trajectories; a row for each start and super-block is shuffled, no pair."""

    def kernel(i0: int, j0: int, dist: np.ndarray, held: dict) -> None:
        far = j0 - i0 - dist.shape[0] + 1 >= apart
        own = dist if far else np.where((j0 + np.arange(dist.shape[1]))[None] - (i0 + np.arange(dist.shape[0]))[:, None] >= apart, dist, 0.0)
        some = np.arange(i0, i0 + len(own)) + apart < j0 + dist.shape[1]  # rows with a pair
        total, seen = held.get(i0, (0.0, False))
        held[i0] = total + own.sum(1), seen | some

    def end(held: dict) -> Iterator[pa.RecordBatch]:
        for i0, (total, seen) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(i0 + np.flatnonzero(seen)), pa.array(total[seen])], ["i", "d"])

    return over_block_pairs(vec, length, kernel, "i long, d double", end).groupBy("i").agg(F.sum("d").alias("total"))


def pairwise_l2(vec: DataFrame) -> DataFrame:
    """Squared distances of all pairs of steps, i < j."""
    return traj_distance(vec, 1)


def traj_matrix(vec: DataFrame, length: int) -> DataFrame:
    """All N * N distances (square roots), diagonal included."""
    half = traj_distance(vec, length).select("i", "j", F.sqrt("d").alias("d"))
    steps, _ = shape(vec)
    diagonal = vec.sparkSession.range(max(0, steps - length + 1)).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(diagonal)


def traj_rows(vec: DataFrame, length: int) -> DataFrame:
    """(i, j, d, mirror): distances (square roots) of i to j and those behind it, a tile's row; ``mirror``: they stand for (j, i) too."""

    def kernel(i0: int, j0: int, dist: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, m = dist.shape
        if i0 == j0:
            np.fill_diagonal(dist, 0)
        d = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(np.sqrt(dist).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(i0 + np.arange(n)), pa.array(np.full(n, j0)), d, pa.array(np.full(n, i0 != j0))], ["i", "j", "d", "mirror"])

    return over_block_pairs(vec, length, kernel, "i long, j long, d array<double>, mirror boolean")


def traj_distance_by_window(vec: DataFrame, length: int, apart: int = 1) -> DataFrame:
    """``traj_distance`` by joins and windows alone: a readable second way, for checks on small series."""
    steps, _ = shape(vec)
    n = steps - length + 1
    shifts = F.explode(F.sequence(F.lit(apart), F.lit(max(apart, steps - 1)))).alias("delta")
    a = vec.select(F.col("t").alias("i"), F.col("x").alias("xa"), shifts)
    b = vec.select(F.col("t").alias("j"), F.col("x").alias("xb"))
    d2 = F.aggregate(F.zip_with("xa", "xb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    steps_apart = a.withColumn("j", F.col("i") + F.col("delta")).join(b, "j").select("i", "j", "delta", d2.alias("d2"))
    w = Window.partitionBy("delta").orderBy("i").rowsBetween(0, length - 1)
    return steps_apart.withColumn("d", F.sum("d2").over(w)).where(F.col("j") <= n - 1).select("i", "j", "d")


def traj_embed(vec: DataFrame, length: int) -> DataFrame:
    """(t, x): the vectors of ``length`` steps from t on, one behind the other."""
    steps, _ = shape(vec)
    parts = vec.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("o")).select((F.col("t") - F.col("o")).alias("t"), "o", "x")
    rows = parts.where((F.col("t") >= 0) & (F.col("t") <= steps - length)).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("r"))
    return rows.select("t", F.flatten(F.transform("r", lambda r: r["x"])).alias("x"))


def cross_similarity(history: DataFrame, query: DataFrame) -> DataFrame:
    """(j, d): distance of the whole query, as one trajectory, to every start in the history; d isn't rooted.

    The query is one trajectory: its rows are dealt with their shift, so a step of
    the history meets each offset in an equi-join and sums are combined map-side.
    """
    steps, _ = shape(history)
    length, _ = shape(query)
    if not 1 <= length <= steps:
        raise ValueError("the query needs a step at least, and no more than the history has")
    h = history.select("t", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("o")).where((F.col("t") >= F.col("o")) & (F.col("t") - F.col("o") <= steps - length))
    q = query.select(F.col("t").alias("o"), F.col("x").alias("y"))
    d2 = F.aggregate(F.zip_with("x", "y", lambda p, r: (p - r) * (p - r)), F.lit(0.0), lambda s, v: s + v)
    return h.join(q, "o").groupBy((F.col("t") - F.col("o")).alias("j")).agg(F.sum(d2).alias("d"))


def overlap_steps(history: DataFrame, query: DataFrame) -> DataFrame:
    """Steps of the history within the query's time span."""
    span = query.agg(F.min("time").alias("_lo"), F.max("time").alias("_hi"))
    return history.join(F.broadcast(span), F.col("time").between(F.col("_lo"), F.col("_hi"))).select("t")  # one row
