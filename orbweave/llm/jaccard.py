"""N-gram Jaccard join with a MinHash LSH forest.

A document is the set of its runs of five words (of all its words, if fewer).
Equal sets form a class, found by digest before anything else. Each class's
signature goes into ``TREES`` trees: a tree is a trie over sorted prefixes, here
the table of (prefix, rest of the prefix, class) in range-partitioned order, so
a hot prefix spreads over tasks. Neighbours in that order share the longest
prefixes; a match counts while they share at least the prefix to which the target
recall lets ``depth`` shorten it. Candidates whose signatures agree enough are
verified on whole sets, each class with its likeliest partner first, then those
that still separate components.

Where a prefix still holds several components, its members of different
components are compared, in blocks, by signature and then on sets. A prefix under
which that would be more than ``CROWD`` pairs isn't shortened so far: it is
lengthened, hash by hash, until its groups are smaller or it is a whole label of
the tree, and its members go into as many more trees of whole labels as bring
back the target recall. Nothing emits all pairs of a group.

Result: one row for each document: its class (least doc_id of its component of
verified links), links of its text with different texts, and rows of its text.
All links are inside components, so once these are known the sets of each
component's members are all compared, in blocks of which only counts come out.
Joins whose keys may be hot (a third of all rows may be copies of one text) meet
the few hot keys, of a number with a bound, by broadcast (``spread``).

Defined results: a null or empty text, or one without words, links with nothing
and is a class of its own. Rows of one doc_id are one document: the classes of
its texts are one, and equal rows count in ``n_copies``. ``stage`` keeps one row
of each component of texts, so of a doc_id's different texts each is kept or
dropped by itself. Rows with a null doc_id aren't joined. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import documents, map_arrow, settle

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.998
TREES, LONGEST = 16, 8
HASHES = TREES * LONGEST
#: Members of a block; pairs of a prefix's different components beyond which it is lengthened.
BLOCK, CROWD = 2048, 1 << 24
#: A key is hot that meets more than so many rows and more than one in so many of them.
HOT_ROWS, HOT_SHARE = 1000, 1000
#: Edges of a task in a step of components; no more than these are one task's, in one step.
FEW_EDGES = 1 << 18

SIGNED = "doc_id long, t long, d1 long, d2 long, n long, keys array<long>, rests array<long>, sig binary"
_REST_BITS = 21


def depth(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which some tree still matches a pair of that similarity with the wanted probability."""
    for d in range(longest, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def more_trees(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """How many trees must join the others for whole labels alone to reach the recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**longest)) - trees)


def sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and len(column) + 1 offsets."""
    h, doc = K.shingles(K.words(column), words)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[once], doc[once]
    return h, np.searchsorted(doc, np.arange(len(column) + 1))


def _functions(n: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of n hash functions."""
    rng = np.random.default_rng(seed)
    return tuple(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


_XOR, _ODD = _functions(HASHES)


def signatures(h: np.ndarray, off: np.ndarray, xor: np.ndarray = _XOR, odd: np.ndarray = _ODD) -> np.ndarray:
    """MinHash values, one row for each set; sets must not be empty."""
    out = np.empty((len(off) - 1, len(xor)), np.uint32)
    i = 0
    while i < len(off) - 1:  # blocks that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 15), "right")) - 1)
        part, cut = h[off[i] : off[j]], (off[i:j] - off[i])
        with np.errstate(over="ignore"):
            for k in range(len(xor)):
                v = (part ^ xor[k]) * odd[k]
                out[i:j, k] = np.minimum.reduceat(v, cut) >> np.uint64(32)
        i = j
    return out


def _labels(sig: np.ndarray, least: int, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each signature and tree (numbered from ``first``) the hashed prefix of ``least`` values, and the rest, some bits of each value, in order."""
    cube = sig.reshape(len(sig), -1, LONGEST).astype(np.uint64)
    key = np.broadcast_to(np.arange(first, first + cube.shape[1], dtype=np.uint64), cube.shape[:2]).copy()
    rest = np.zeros_like(key)
    with np.errstate(over="ignore"):
        for k in range(least):
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + cube[:, :, k])
    for k in range(least, min(LONGEST, least + 3)):
        rest |= (cube[:, :, k] >> np.uint64(32 - _REST_BITS)) << np.uint64(_REST_BITS * (2 - (k - least)))
    return key, rest


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(np.ascontiguousarray(a).reshape(-1).view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch], least: int, words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, off = sets(b.column("text"), words)
        n = np.diff(off)
        real = np.flatnonzero(n > 0)
        sig, d1, d2 = np.zeros((len(n), HASHES), np.uint32), np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        if len(real):
            off_real = np.append(off[:-1][real], off[-1])
            sig[real] = signatures(h, off_real)
            with np.errstate(over="ignore"):
                d1[real] = np.add.reduceat(K.mix(h), off_real[:-1])
                d2[real] = np.add.reduceat(K.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), off_real[:-1])
        key, rest = _labels(sig, least)
        low = (sig & 0xFF).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n), _lists(key), _lists(rest), pa.array([r.tobytes() for r in low], pa.binary())], [c.split()[0] for c in SIGNED.split(", ")])


def spread(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``table``, whose ``on`` is unique and whose ``size`` says how many of the rows each meets.

    Hot keys, fewer than ``HOT_SHARE``, are met by broadcast, the others in a
    shuffle, so no task gets all rows of a key.
    """
    total, most = table.agg(F.sum(size), F.max(size)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if not most or most <= least:
        return rows.join(table, on)
    hot = F.broadcast(table.where(F.col(size) > least))
    cold = rows.join(F.broadcast(table.where(F.col(size) > least).select(*on)), on, "left_anti").join(table.where(F.col(size) <= least), on)
    return rows.join(hot, on).unionByName(cold)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from the low bytes of signatures."""
    same = (a == b).mean(-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _neighbours(prefixes: DataFrame) -> DataFrame:
    """Pairs of classes next to each other under one key, in the order of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple[np.ndarray, np.ndarray] | None = None

        def told(a: np.ndarray, b: np.ndarray, key: int | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([key] * len(a), pa.int64()), pa.array([part] * len(a), pa.int32())], ["a", "b", "key", "part"])

        for batch in batches:
            key, cid = batch.column("key").to_numpy(), batch.column("cid").to_numpy()
            if not len(key):
                continue
            if last is None:
                yield told(cid[:1], np.zeros(1, np.int64), int(key[0]))
            else:
                key, cid = np.append(last[0], key), np.append(last[1], cid)
            same = (key[1:] == key[:-1]) & (cid[1:] != cid[:-1])
            if same.any():
                yield told(np.minimum(cid[1:], cid[:-1])[same], np.maximum(cid[1:], cid[:-1])[same])
            last = key[-1:], cid[-1:]
        if last is not None:
            yield told(last[1], np.ones(1, np.int64), int(last[0][0]))

    dealt = prefixes.repartitionByRange("key", "rest", "cid").sortWithinPartitions("key", "rest", "cid")
    made = settle(map_arrow(dealt, run, "a long, b long, key long, part int"))
    # a partition's first and last rows: neighbours where a key goes on in the next partition
    order = Window.partitionBy("key").orderBy("part", "b")
    ends = made.where("key is not null").withColumn("before", F.lag(F.struct("a", "part")).over(order)).where("before.part < part and before.a <> a")
    ends = ends.select(F.least("a", F.col("before.a")).alias("x"), F.greatest("a", F.col("before.a")).alias("y"))
    return made.where("key is null").select("a", "b").unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()


def _agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree enough, and how much."""
    sig = reps.select("cid", "sig")
    both = pairs.join(sig.withColumnsRenamed({"cid": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"cid": "b", "sig": "sb"}), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
                est = _agreement(x, y)
                ok = est >= least
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok)), pa.array(est[ok])], ["a", "b", "est"])

    return map_arrow(both, run, "a long, b long, est double")


def _bitmap(ids: DataFrame, n: int) -> np.ndarray:
    """A set of ids as bits, of a size that follows their number and has a bound; may hold others too."""
    bits = 1 << min(26, max(16, (8 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = (K.mix(b.column("id").to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for r in map_arrow(ids.coalesce(8), run, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return total


def _in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = (K.mix(ids.view(np.uint64)) & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7)) & 1 > 0


def _sets(ids: DataFrame, n: int, reps: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(cid, h): the sets of about n classes' texts.

    A bitmap of bounded size picks the texts (and a few more), the join keeps theirs.
    """
    wanted = reps.select("cid", "first.*").join(ids.distinct(), "cid")
    bitmap = _bitmap(wanted.select(F.col("doc_id").alias("id")), n)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.flatnonzero(_in_bitmap(bitmap, b.column("doc_id").to_numpy()))
            for i in range(0, len(keep), 256):
                part = pa.array(keep[i : i + 256])
                h, off = sets(b.column("text").take(part), words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(part), b.column("t").take(part), pa.array([h[off[k] : off[k + 1]].tobytes() for k in range(len(off) - 1)], pa.binary())], ["doc_id", "t", "h"])

    made = map_arrow(texts, hashes, "doc_id long, t long, h binary")
    return made.join(wanted, ["doc_id", "t"]).dropDuplicates(["cid"]).select("cid", "h")


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets reach the similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (settled) that reach the similarity, from whole texts."""
    n = 2 * pairs.count()
    if not n:
        return pairs.select("a", "b")
    own = _sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")), n, reps, texts, words)
    both = pairs.select("a", "b").join(own.withColumnsRenamed({"cid": "a", "h": "ha"}), "a").join(own.withColumnsRenamed({"cid": "b", "h": "hb"}), "b").select("a", "b", "ha", "hb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("ha"), b.column("hb"), strict=True)):
                ok[i] = _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return map_arrow(both, compare, "a long, b long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of few edges: roots of both ends are joined, all paths shortened, until nothing changes."""
    got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64)] + [g[k] for g in got]) for k in (0, 1))
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(node))
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each other node's component, by alternating large-star and small-star steps."""

    def star(e: DataFrame, large: bool, parts: int) -> DataFrame:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        # here a is the centre; small stars only look at lower neighbours
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n"))
        joined = spread(near, least, ["a"], "_n").select("a", "b", "m").coalesce(parts)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")).coalesce(parts))
        return out.where("a > b").distinct().coalesce(parts)

    total = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = total(now)
    if before[0] <= FEW_EDGES:
        return settle(map_arrow(now.coalesce(1), _joined, "node long, comp long"))
    while True:
        # a step makes no more edges than there are, which need fewer tasks and files than the texts
        parts = max(4, -(-before[0] // FEW_EDGES))
        now = settle(star(star(now.coalesce(parts), True, parts), False, parts))
        after = total(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _labelled(reps: DataFrame, comps: DataFrame) -> DataFrame:
    return reps.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _crowded(prefixes: DataFrame) -> DataFrame:
    """Prefixes of three classes or more, settled: of two, the neighbours were all there is to compare."""
    many = prefixes.groupBy("key").agg(F.count("*").alias("_m")).where("_m >= 3")
    return settle(spread(prefixes.select("key", "rest", "cid"), many, ["key"], "_m").select("key", "rest", "cid"))


def _mixed(crowded: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the prefixes that hold several components: with the number of all, the largest component and its number."""
    placed = _labelled(crowded, comps)
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.count("*").alias("k"), F.max(F.struct("c", "comp")).alias("top")).where("k >= 2")
    mixed = settle(mixed.select("key", "m", F.col("top.comp").alias("base"), F.col("top.c").alias("c")))
    return settle(spread(placed, mixed, ["key"], "m"))


def _forest(crowded: DataFrame, reps: DataFrame, comps: DataFrame, texts: DataFrame, similarity: float, recall: float, agree: float, words: int, least: int) -> DataFrame:
    """Links between different components under one prefix, lengthened where it is crowded."""
    ready, longer = [], []
    members = _mixed(crowded, comps)
    for _ in range(least, LONGEST):
        over = settle(members.where(F.col("m") * (F.col("m") - F.col("c")) > CROWD))
        if not over.take(1):
            break
        ready.append(members.where(F.col("m") * (F.col("m") - F.col("c")) <= CROWD))
        longer.append(over.select("cid"))
        # the next value joins the prefix
        bits = (1 << _REST_BITS) - 1
        following = over.select(F.xxhash64("key", F.shiftrightunsigned("rest", 2 * _REST_BITS)).alias("key"), F.shiftleft(F.col("rest").bitwiseAND(F.lit((bits << _REST_BITS) | bits).cast("long")), _REST_BITS).alias("rest"), "cid")
        members = _mixed(following, comps)
    ready.append(members)
    if longer:
        ids = longer[0]
        for more in longer[1:]:
            ids = ids.unionByName(more)
        ids = settle(ids.distinct())
        n = more_trees(similarity, recall)

        def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            xor, odd = _functions(n * LONGEST, 18)
            for b in batches:
                h = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("h")]
                if h:
                    sig = signatures(np.concatenate(h), np.concatenate([[0], np.cumsum([len(x) for x in h])]), xor, odd)
                    yield pa.RecordBatch.from_arrays([b.column("cid"), _lists(_labels(sig, LONGEST, TREES + 1)[0])], ["cid", "keys"])

        own = map_arrow(_sets(ids, ids.count(), reps, texts, words), labels, "cid long, keys array<long>")
        ready.append(_mixed(settle(own.select(F.explode("keys").alias("key"), F.lit(0).cast("long").alias("rest"), "cid")), comps))
    found = None
    for members in ready:
        part = _across(members, reps, texts, similarity, agree, words)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _across(members: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float, agree: float, words: int) -> DataFrame:
    """Links between different components under one prefix: every member outside a prefix's largest component is held against all members.

    Members come in blocks, with their sets; a pair of blocks meets in one task.
    There signatures leave the pairs that can be similar, likeliest first, and
    sets decide; once a member is linked to a component its other pairs with that
    component can't change a class. What comes out is links, not pairs.
    """
    n = members.count()
    if not n:
        return members.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    own = _sets(members.select("cid"), n, reps, texts, words)
    known = members.join(reps.select("cid", "sig"), "cid").join(own, "cid")
    # one side: members outside the largest component; other side: all. Both cut into blocks, each side repeated for the other's.
    n_left = F.ceil((F.col("m") - F.col("c")) / BLOCK).cast("int")
    n_all = F.ceil(F.col("m") / BLOCK).cast("int")
    spot = F.when(F.col("comp") != F.col("base"), F.transform(F.sequence(F.lit(0), n_all - 1), lambda j: F.struct(F.lit(True).alias("left"), F.pmod(F.xxhash64("cid"), n_left).cast("int").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<left:boolean,i:int,j:int>>"))
    every = F.transform(F.sequence(F.lit(0), n_left - 1), lambda i: F.struct(F.lit(False).alias("left"), i.alias("i"), F.pmod(F.xxhash64("cid"), n_all).cast("int").alias("j")))
    dealt = known.select("key", "cid", "comp", "sig", "h", F.explode(F.concat(spot, every)).alias("z")).select("key", "z.i", "z.j", "z.left", "cid", "comp", "sig", "h")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid")

    def links(group: list) -> Iterator[tuple[int, int]]:
        rep, comp, sig, left = (np.concatenate([g[k] for g in group]) for k in range(4))
        h = [x for g in group for x in g[4]]
        right = np.flatnonzero(~left)
        for x in np.flatnonzero(left).tolist():
            est = _agreement(sig[x][None], sig[right])
            est[comp[right] == comp[x]] = 0
            joined = set()
            for y in right[np.argsort(-est, kind="stable")][: int((est >= agree).sum())].tolist():
                if comp[y] not in joined and _similar(h[x], h[y], similarity):
                    joined.add(comp[y])
                    yield int(rep[x]), int(rep[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(group: list) -> Iterator[pa.RecordBatch]:
            found = list(links(group)) if group else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], ["a", "b"])

        group, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1)
            cols = (b.column("cid").to_numpy(), b.column("comp").to_numpy(), np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES), b.column("left").to_numpy(zero_copy_only=False).astype(bool), [np.frombuffer(x.as_py(), np.uint64) for x in b.column("h")])
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(place)), strict=True):
                if at is not None and (place[lo] != at).any():
                    yield from told(group)
                    group = []
                at = place[lo]
                group.append([c[lo:hi] for c in cols])
        yield from told(group)

    return map_arrow(dealt, run, "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of x shares with each of y.

    Values in many sets of both are columns of a matrix product; the rest are met one by one.
    """
    out = np.zeros((len(x), len(y)), np.float32)
    a, b = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(a, b)
    if not len(shared):
        return out

    def places(h: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        own = shared[t] == h
        t, i = t[own], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[own]
        order = np.argsort(t, kind="stable")
        return t[order], i[order]

    (ta, ia), (tb, ib) = places(a, x), places(b, y)
    na, nb = np.bincount(ta, minlength=len(shared)), np.bincount(tb, minlength=len(shared))
    fa, fb = np.append(0, np.cumsum(na)), np.append(0, np.cumsum(nb))
    dense = np.flatnonzero(100 * na * nb > out.size)
    for k in range(0, len(dense), 2048):
        part = dense[k : k + 2048]
        left, right = np.zeros((len(x), len(part)), np.float32), np.zeros((len(y), len(part)), np.float32)
        left[ia[K.ragged(fa[part], na[part])], np.repeat(np.arange(len(part)), na[part])] = 1
        right[ib[K.ragged(fb[part], nb[part])], np.repeat(np.arange(len(part)), nb[part])] = 1
        out += left @ right.T
    few = np.flatnonzero(100 * na[ta] * nb[ta] <= out.size)
    cost = np.cumsum(nb[ta[few]])
    k = 0
    while k < len(few):
        until = max(k + 1, int(np.searchsorted(cost, (cost[k - 1] if k else 0) + (1 << 22), "right")))
        t, i = ta[few[k:until]], ia[few[k:until]]
        out += np.bincount(np.repeat(i, nb[t]) * len(y) + ib[K.ragged(fb[t], nb[t])], minlength=out.size).reshape(out.shape)
        k = until
    return out


def _degrees(reps: DataFrame, comps: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(cid, n_links): links of each member of the components of three classes or more, from whole sets.

    Members come in blocks; a pair of blocks meets in one task, which tells one count for each member.
    """
    sizes = settle(comps.groupBy("comp").agg((F.count("*") + 1).alias("m")).where("m >= 3"))
    members = settle(spread(_labelled(reps.select("cid"), comps), sizes, ["comp"], "m"))
    n = members.count()
    if not n:
        return members.select("cid", F.lit(0).cast("long").alias("n_links"))
    own = _sets(members.select("cid"), n, reps, texts, words)
    n_blocks = F.ceil(F.col("m") / F.least(F.lit(BLOCK), F.greatest(F.lit(256), F.ceil(F.col("m") / 16)))).cast("int")
    mine = F.pmod(F.xxhash64("cid"), n_blocks).cast("int")
    dealt = members.join(own, "cid").select("comp", "cid", "h", mine.alias("mine"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    dealt = dealt.select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "h")
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cid")

    def counts(at: np.ndarray, group: list) -> pa.RecordBatch:
        rep, mine = (np.concatenate([g[k] for g in group]) for k in range(2))
        h = [x for g in group for x in g[2]]
        left, right = np.flatnonzero(mine == at[1]), np.flatnonzero(mine == at[2])
        n = np.zeros(len(rep), np.int64)
        if len(left) and len(right):
            size = np.array([len(x) for x in h])
            both = overlaps([h[k] for k in left], [h[k] for k in right])
            ok = both >= similarity * (size[left][:, None] + size[right] - both) - 1e-9
            if at[1] == at[2]:
                np.fill_diagonal(ok, False)
            else:
                n[right] = ok.sum(0)
            n[left] = ok.sum(1)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n)], ["cid", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("comp", "i", "j")], 1)
            cols = (b.column("cid").to_numpy(), b.column("mine").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in b.column("h")])
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(place)), strict=True):
                if at is not None and (place[lo] != at).any():
                    yield counts(at, group)
                    group = []
                at = place[lo]
                group.append([c[lo:hi] for c in cols])
        if group:
            yield counts(at, group)

    return map_arrow(dealt, run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n_links"))


@dataclass
class Linked:
    """Classes of equal texts: (doc_id, t, cid) of all documents, cid null without words; the classes; (node, comp) of components; links of each class."""

    own: DataFrame
    classes: DataFrame
    comps: DataFrame
    degree: DataFrame


def linked(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> Linked:
    """All links between the texts of documents that have a doc_id."""
    least = depth(similarity, recall)
    agree = max(0.0, similarity - 4 * math.sqrt(similarity * (1 - similarity) / HASHES))
    texts = documents(docs).where("doc_id is not null").withColumn("t", F.xxhash64("text"))
    signed = settle(map_arrow(texts, lambda batches: _sign(batches, least, words), SIGNED))
    grouped = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count("*").alias("n_copies"), F.first("keys").alias("keys"), F.first("rests").alias("rests"), F.first("sig").alias("sig"))
    reps = settle(grouped.withColumn("cid", F.monotonically_increasing_id()))
    prefixes = reps.select("cid", F.explode(F.arrays_zip("keys", "rests")).alias("z")).select(F.col("z.keys").alias("key"), F.col("z.rests").alias("rest"), "cid")
    candidates = settle(_agreeing(_neighbours(prefixes), reps, agree))
    likeliest = settle(candidates.groupBy("b").agg(F.max(F.struct("est", F.negative("a").alias("m"))).alias("z")).select(F.negative("z.m").alias("a"), "b"))
    links = settle(verify(likeliest, reps, texts, similarity, words))
    comps = components(links)
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias("c" + c))
    rest = candidates.select("a", "b").join(likeliest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = settle(rest.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))
    new = settle(verify(more, reps, texts, similarity, words))
    if new.take(1):
        links = links.unionByName(new)
        comps = components(links)
    new = settle(_forest(_crowded(prefixes), reps, comps, texts, similarity, recall, agree, words, least))
    if new.take(1):
        links = links.unionByName(new)
        comps = components(links)
    # a component of two has its one link; in larger ones links were only sought until they were joined
    all_of = settle(_degrees(reps, comps, texts, similarity, words))
    pairs = links.distinct().select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    degree = pairs.join(all_of, "cid", "left_anti").unionByName(all_of)
    none = signed.where("n = 0").select("doc_id", "t", F.lit(None).cast("long").alias("cid"))
    own = spread(signed.where("n > 0").select("doc_id", "t", "d1", "d2", "n"), reps.select("d1", "d2", "n", "cid", "n_copies"), ["d1", "d2", "n"], "n_copies").select("doc_id", "t", "cid")
    return Linked(settle(own.unionByName(none)), reps.select("cid", "first", "n_copies"), comps, degree)


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document with a doc_id."""
    found = linked(docs, similarity, words, recall)
    comps = found.comps
    # pairs of a document's own classes
    same = found.own.where("cid is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.count_distinct("cid").alias("k")).where("k > 1")
    same = settle(found.own.join(same, "doc_id").where("cid <> a").select("a", F.col("cid").alias("b")).distinct())
    if same.take(1):
        comps = components(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(same))
    labelled = settle(_labelled(found.classes, comps))
    lowest = settle(labelled.groupBy("comp").agg(F.min("first.doc_id").alias("class_id"), F.count("*").alias("_n")))
    told = spread(labelled, lowest, ["comp"], "_n").join(found.degree, "cid", "left").select("cid", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    mapped = spread(found.own.where("cid is not null").select("doc_id", "cid"), settle(told), ["cid"], "n_copies").distinct()
    alone = found.own.where("cid is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    every = mapped.select("doc_id", "class_id", "n_links", "n_copies").unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"), F.max("n_copies").alias("n_copies"))
    return every.withColumn("class_id", F.coalesce("class_id", "doc_id"))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    from .runtime import table

    return join(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB's SQL, for tables of unique doc_ids: all pairs that share a run of words."""
    return f"""
with recursive w as (select doc_id::bigint doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {WORDS} then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) end) sh from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y, c = nx.n and c = ny.n as equal from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where c >= {SIMILARITY} * (nx.n + ny.n - c) - 1e-9),
e as (select x, min(y) least from l where equal group by x),
rep as (select doc_id, least(doc_id, coalesce(least, doc_id)) rep from w left join e on x = doc_id),
reach(doc_id, y) as (select doc_id, doc_id from w union select r.doc_id, l.y from reach r join l on l.x = r.y),
links as (select l.x, count(distinct rep.rep) n from l join rep on rep.doc_id = l.y where not equal group by 1),
copies as (select x, count(*) n from l where equal group by 1)
select r.doc_id, min(r.y)::bigint class_id, coalesce(any_value(links.n), 0)::bigint n_links, coalesce(any_value(copies.n), 0)::bigint + 1 n_copies
from reach r left join links on links.x = r.doc_id left join copies on copies.x = r.doc_id group by r.doc_id"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts, with its columns: that of least doc_id. Rows without a doc_id or without words stay, equal ones once."""
    found = linked(docs)
    first = _labelled(found.classes, found.comps).groupBy("comp").agg(F.min("first").alias("z")).select("z.*")
    kept = first.unionByName(found.own.where("cid is null").select("doc_id", "t")).distinct()
    named = docs.where("doc_id is not null").withColumn("_orbweave_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    key = [F.col("doc_id").cast("long") == F.col("_orbweave_id"), F.col("_orbweave_t") == F.col("_orbweave_key")]
    of = lambda ids: ids.select(F.col("doc_id").alias("_orbweave_id"), F.col("t").alias("_orbweave_key"))
    named = named.join(of(kept), key, "left_semi")
    # a doc_id that stands with the same text in several rows: one of them, whichever task asks
    again = settle(found.own.groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t"))
    if again.take(1):
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = named.join(of(again), key, "left_semi").groupBy("doc_id", "_orbweave_t").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_orbweave_row")).select("_orbweave_row.*")
        named = named.join(of(again), key, "left_anti").select(*docs.columns).unionByName(one)
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
