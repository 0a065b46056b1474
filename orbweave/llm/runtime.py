"""What the operators of this subpackage share: reading, batches, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: with very long texts a batch must still fit a Python worker.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``; never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, on one machine only, a temporary folder.

    Raises where that is unset and executors are elsewhere, as they would write where nobody else can read.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orbweave-"))
        _until_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    return folder or sc._jsc.sc().getCheckpointDir().get()


def _until_exit(spark: SparkSession, folder: str) -> None:
    """Have a folder deleted when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is written there goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    _until_exit(spark, folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there; what the driver has freed goes back to the system."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    release_driver(df.sparkSession)
    return out


def release_driver(spark: SparkSession) -> str:
    """``release`` in the driver, and the same of its JVM: the C library's pools of its many threads keep what plans and compilers have freed. What the JVM said, nothing where it has no such command."""
    release()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    of = jvm.java.lang.Class.forName
    kinds = array(jvm.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    with contextlib.suppress(Py4JError):  # the server's own class is hidden, its interface isn't
        call = of("javax.management.MBeanServer").getMethod("invoke", kinds)
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return str(call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, name, "systemTrimNativeHeap", None, None)))
    return ""


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` in small batches; what a task has freed goes back to the system, as its worker stays."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory that Arrow and the C library keep back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def fold(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crc_order(column: str) -> Column:
    """A fixed pseudo-random order of ids."""
    return F.xxhash64(F.col(column))


def documents(df: DataFrame) -> DataFrame:
    """doc_id and whole text only; a null text counts as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
