"""Token ids in compressed files with a shared dictionary.

File format (one binary row of a Parquet table per file, so that any shared
store that Spark writes to will do): documents in ascending doc_id order, each
one's little-endian unsigned 32-bit ids compressed by itself as a zstandard
frame against one dictionary, trained on a bounded sample of documents. A row
keeps the frames' bytes, the offset index (doc_id, place and bytes of the frame,
id count), its least and highest doc_id, where its first id stands among its
part's, and the dictionary's SHA-256. So one short document is read from the rows
whose range it is in, by its frame alone, and never with the wrong dictionary.

Defined results: a null or empty text is the end id alone; repeated rows are
stored each, in a fixed order; a null doc_id comes first. An empty table gives
an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder, vocabulary
from .runtime import crc_order, documents, map_arrow

END_ID = 2
#: The dictionary is trained on so many documents, of so many ids each, and bytes in all, at most; its size; ids in a file, about.
SAMPLE, SAMPLE_IDS, SAMPLE_BYTES, DICT_BYTES, FILE_IDS = 2_000, 8192, 16 << 20, 64 << 10, 4 << 20
LEVEL = 3
FILES = "part long, seq long, first long, low long, high long, dict_sha256 string, n_ids long, index binary, frames binary"
_ENTRY = "<qqqq"  # doc_id, place of the frame, its bytes, ids
_NULL_ID = -(1 << 63)


def train(docs: DataFrame, path: str, end_id: int = END_ID) -> bytes:
    """A raw dictionary from a sample of at most ``SAMPLE`` documents in a fixed pseudo-random order."""
    import zstandard as zstd

    ids = docs.select("doc_id").orderBy(crc_order("doc_id"), "doc_id").limit(SAMPLE)
    texts = documents(docs).join(F.broadcast(ids.distinct()), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            got, off = enc.encode(b.column("text"))
            small = [i for i in range(b.num_rows) if off[i + 1] - off[i] <= SAMPLE_IDS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(small, pa.int64())), pa.array([got[off[i] : off[i + 1]].astype("<u4").tobytes() for i in small], pa.binary())], ["doc_id", "raw"])

    rows = map_arrow(texts, run, "doc_id long, raw binary").orderBy("doc_id").limit(SAMPLE).collect()
    samples, total = [], 0
    for r in rows:
        if len(r["raw"]) >= 8 and total < SAMPLE_BYTES:
            samples.append(bytes(r["raw"]))
            total += len(r["raw"])
    if len(samples) < 16 or total < 4 * DICT_BYTES:
        return b"".join(samples)[-DICT_BYTES:]
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def write(docs: DataFrame, out: str, path: str, dictionary: bytes, end_id: int = END_ID, level: int = LEVEL) -> None:
    """Write the store of all documents to the folder ``out`` (files, then the dictionary)."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        press = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)
        digest = hashlib.sha256(dictionary).hexdigest()
        index, frames, n_ids, place, first, low, high = [], [], 0, 0, 0, None, None
        tail = np.array([end_id], "<u4")

        def row() -> pa.RecordBatch:
            values = [part, seq, first, low, high, digest, n_ids, b"".join(index), b"".join(frames)]
            names, kinds = zip(*(c.split() for c in FILES.split(", ")), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for v, t in zip(values, kinds, strict=True)], list(names))

        for b in batches:
            got, off = enc.encode(b.column("text"))
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                ids = np.concatenate([got[off[i] : off[i + 1]].astype("<u4", copy=False), tail])
                frame = press.compress(ids.tobytes())
                doc = _NULL_ID if doc is None else doc  # nulls come first
                low, high = doc if low is None else low, doc
                index.append(struct.pack(_ENTRY, doc, place, len(frame), len(ids)))
                frames.append(frame)
                place += len(frame)
                n_ids += len(ids)
                if n_ids >= FILE_IDS:
                    yield row()
                    index, frames, n_ids, place, seq, first, low = [], [], 0, 0, seq + 1, first + n_ids, None
        if index:
            yield row()

    ordered = documents(docs).withColumn("tie", F.xxhash64("text"))
    # doc_id ranges, so the store is in ascending order over all files; the hash deals a hot id's copies out in a fixed order
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    map_arrow(ordered.drop("tie"), run, FILES).write.parquet(f"{out}/files")
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")


def _dictionary(spark: SparkSession, out: str) -> bytes:
    r = spark.read.parquet(f"{out}/dictionary").first()
    got = bytes(r["dictionary"])
    if hashlib.sha256(got).hexdigest() != r["dict_sha256"]:
        raise ValueError(f"the dictionary in {out} doesn't match its hash")
    return got


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids of every document, from the files."""
    dictionary = _dictionary(spark, out)
    digest = hashlib.sha256(dictionary).hexdigest()
    files = spark.read.parquet(f"{out}/files")
    # files know their places within their part; of the parts, as many as the write had tasks, each tells one sum
    starts, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        press = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for part, begin, sha, index, frames in zip(*(b.column(c) for c in ("part", "first", "dict_sha256", "index", "frames")), strict=True):
                if sha.as_py() != digest:
                    raise ValueError("a file was written with another dictionary")
                at, data = starts[part.as_py()] + begin.as_py(), memoryview(frames.as_buffer())
                rows: list[list] = [[], [], [], []]
                for doc, place, size, n in struct.iter_unpack(_ENTRY, index.as_buffer()):
                    ids = press.decompress(data[place : place + size])
                    if len(ids) != 4 * n:
                        raise ValueError("a frame doesn't hold the ids that its index promises")
                    for x, v in zip(rows, (None if doc == _NULL_ID else doc, at, n, zlib.crc32(ids)), strict=True):
                        x.append(v)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row is a file of some megabytes: a few in a batch
    from .runtime import small_batches

    small_batches(spark)
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, out: str, doc_id: int | None) -> list[list[int]]:
    """Ids of one document (all its rows): reads the files whose range holds it, decompresses its frames alone."""
    dictionary = _dictionary(spark, out)
    digest, wanted = hashlib.sha256(dictionary).hexdigest(), _NULL_ID if doc_id is None else doc_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        press = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for part, seq, sha, index, frames in zip(*(b.column(c) for c in ("part", "seq", "dict_sha256", "index", "frames")), strict=True):
                if sha.as_py() != digest:
                    raise ValueError("a file was written with another dictionary")
                entries, data = np.frombuffer(index.as_buffer(), "<i8").reshape(-1, 4), memoryview(frames.as_buffer())
                mine = entries[entries[:, 0] == wanted]
                got = [press.decompress(data[p : p + size]) for _, p, size, _ in mine.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(got), pa.int64()), pa.array([seq.as_py()] * len(got), pa.int64()), pa.array(range(len(got)), pa.int64()), pa.array(got, pa.binary())], ["part", "seq", "k", "ids"])

    files = spark.read.parquet(f"{out}/files").where((F.col("low") <= wanted) & (F.col("high") >= wanted)).select("part", "seq", "dict_sha256", "index", "frames")
    found = files.mapInArrow(run, "part long, seq long, k long, ids binary").orderBy("part", "seq", "k").collect()
    return [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in found]


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    """Write the store of all documents and read it back."""
    from .runtime import scratch, table

    docs = table(spark, sf_dir, "documents")
    path = vocabulary("word_bpe_49k.json")
    out = scratch(spark, "ids")
    write(docs, out, path, train(docs, path))
    return read(spark, out)
