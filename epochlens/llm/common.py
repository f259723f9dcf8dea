"""What the operators share: scratch tables, size-checked joins, byte columns, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes, counted before; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # not on this platform
    _libc = None
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows in a batch that travels between Spark and Python; whole texts and sets are large, so far fewer than the default.
ARROW_ROWS = "512"


def small_batches(df: DataFrame) -> None:
    """Let Python tasks of this session take small batches, unless the session has its own setting."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, ARROW_ROWS)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, and any other an error:
    a folder of the driver's machine is none of the executors'."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark, "_epochlens_scratch", "")
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="epochlens-")
            spark._epochlens_scratch = root
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_root(spark)}/epochlens-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Shuffle files go when the query that made them ends, while this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files at their end, which else stay until the driver's heap is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Lost executors cost no earlier work."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    made = getattr(spark, "_epochlens_made", None)
    if made is not None:
        made.append(out)
    return out


def saved_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``saved`` of what ``make`` returns, unless that is a scratch table itself; the others that it made on the way are deleted, as nothing reads them any more."""
    outer, made = getattr(spark, "_epochlens_made", None), []
    spark._epochlens_made = made
    try:
        out = make()
        out = out if getattr(out, "_scratch", None) is not None else saved(out, name)
    finally:
        spark._epochlens_made = outer
    discard(*(t for t in made if t is not out))
    if outer is not None:
        outer.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of ``saved`` that nothing will read any more; the others go when the driver ends."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_scratch", None)
        if path is not None:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds each named sum over all rows up to this one. Rows of one part are summed by one task, and then one row per part."""
    columns = df.columns
    parts = saved(df.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as the exchange has partitions.
    ahead = parts.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in sums])
    ahead = ahead.select("__part", *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.withColumns({k: F.sum(f"__{k}").over(own) for k in sums}).join(F.broadcast(ahead), "__part")
    return joined.select(*columns, *[(F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums])


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Join with a broadcast of ``small`` when its counted size is within the bound, else by a shuffle."""
    rows = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small.hint("shuffle_merge"), on, how)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def trim() -> None:
    """Give memory that a Python task no longer uses back to the system; idle workers stay small beside the executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches, rows: int = 256, column: int = 1, max_bytes: int = 4 << 20):
    """Arrow batches in pieces of bounded bytes, so that temporary arrays stay small."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, total = 0, 0
        for i in range(n):
            if i > start and (total + sizes[i] > max_bytes or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += sizes[i]
        yield batch.slice(start)
    trim()


def gathered(batches, rows: int, max_bytes: int, column: int = 1):
    """Arrow batches put together up to about ``rows`` rows or ``max_bytes`` bytes of a column, then cut to that size."""
    held, n, size = [], 0, 0
    for batch in slices(batches, rows, column, max_bytes):
        more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and (n + batch.num_rows > rows or size + more > max_bytes):
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, n, size = [], 0, 0
        held.append(batch)
        n, size = n + batch.num_rows, size + more
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, for uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
