"""What the operators share on the side of Spark: shared folders, cuts of the lineage, numbers of blocks."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where all share one machine, one set here."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file:///tmp/tessella-shared"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; later steps read them there, whichever executors are lost."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As cut(), for wide rows: a compressed Parquet table in the shared folder."""
    spark = df.sparkSession
    at = f"{shared(spark)}/tessella-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table() that is not read any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if path.getName().startswith("tessella-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame, mb: int = 64) -> int:
    """A number of blocks that follows the input's size: about `mb` of stored input a block, the session's shuffle partitions at least.

    Packed rows go from each task to each block, so blocks are as large as a worker can hold, not as small as can be.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if size >= 1 << 55:  # Spark does not know the size, so the texts are measured; stored ones take about a third
        size = (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 3 if "text" in df.columns else 0
    return max(least, min(size // (mb << 20), 1 << 21))


#: Rows of a table that looked_up() broadcasts, at most.
HOT_KEYS = 20_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str, inner: bool = False, made: Column | None = None) -> DataFrame:
    """rows with the columns of table(key, ...), which has each key once and in column n the number of rows with it.

    Keys of more than a HOT_KEYS-th of all rows are at most HOT_KEYS, so their part of the table is broadcast and their
    rows are not shuffled; the other keys are joined as usual. rows are read twice, so they should be stored. made: the
    key of rows, where it is no column of theirs. With `inner`, rows without a key in the table are left out.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    least = max(total // HOT_KEYS, 100)
    other = table.drop(n).withColumnRenamed(key, "_key")
    held = rows.withColumn("_own", F.col(key) if made is None else made)
    hot = table.filter(F.col(n) > least).select(F.col(key).alias("_hot"))  # at most HOT_KEYS rows
    if hot.isEmpty():
        return held.join(other, F.col("_own") == F.col("_key"), "inner" if inner else "left").drop("_own", "_key")
    head = table.filter(F.col(n) > least).drop(n).withColumnRenamed(key, "_key")
    a = held.join(F.broadcast(head), F.col("_own") == F.col("_key"))
    b = held.join(F.broadcast(hot), F.col("_own") == F.col("_hot"), "left_anti").join(table.filter(F.col(n) <= least).drop(n).withColumnRenamed(key, "_key"), F.col("_own") == F.col("_key"), "inner" if inner else "left")
    return a.unionByName(b).drop("_own", "_key")


def free(columns: list[str], name: str) -> str:
    """The name, with underscores after it where the columns have it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def planes(x: np.ndarray) -> bytes:
    """Bytes of an unsigned array, all first bytes first: long runs for Spark's codec where the upper bytes are small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def deltas(x: np.ndarray) -> bytes:
    """A sorted unsigned array as its differences."""
    d = x.copy()
    d[1:] -= x[:-1]
    return planes(d)


def undeltas(b: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unplanes(b, kind), dtype=kind)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def trim() -> None:
    """Gives memory that a worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def frugal(run):
    """A function of a group that gives its memory back."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            trim()

    return wrapped


def frugal_pair(run):
    """As frugal(), for a function of two groups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            trim()

    return wrapped


def release() -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more. Python's side lets go of them in a
    thread of its own, and Spark's cleaner works in another, hence the pauses."""
    import gc
    import time

    from pyspark import SparkContext

    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        if SparkContext._active_spark_context is not None:
            SparkContext._active_spark_context._jvm.System.gc()
        time.sleep(0.2)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, by its upper 32 bits: buckets are ranges of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def bounds(sorted_hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of every bucket that has some of the sorted hashes."""
    if not len(sorted_hashes):
        return []
    b = bucket_of(sorted_hashes, n)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return list(zip(b[at].tolist(), at.tolist(), [*at[1:].tolist(), len(b)], strict=True))
