"""What the operators share: table access, shared scratch tables, release of finished phases."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset: a folder of our own if the master is
    local, as in tests; an error on a cluster, whose executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lacuna/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and nothing reads any more."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int | None = None, most: int = 200_000) -> DataFrame:
    """A table that materialise() wrote, to be broadcast if it has at most so many rows and 32 MB on disk, else
    left to a shuffle."""
    spark = df.sparkSession
    if (df.count() if rows is None else rows) > most:
        return df
    path = getattr(df, "_scratch", None)
    if path is None:
        return F.broadcast(df)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if size <= 32 << 20 else df


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """The names, with as many underscores after them as it takes to differ from the taken ones (in any case)."""
    used = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        out.append(n)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of phases whose plans are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python by 512 rows unless the session says otherwise. At Spark's 10,000 each task holds all of them
    several times over, in the JVM's Arrow buffers and in the worker, whose allocators keep the room."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "512")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return to the system what the allocators hold of freed memory."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task; at its end the worker, which idles on beside the next phases, gives back what it no longer needs."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
