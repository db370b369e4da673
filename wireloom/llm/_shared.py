"""Tables written in the folder that the cluster shares.

Iterative and multi-pass operators cut their lineage by writing a table there
and reading it again, so that a lost executor costs a rerun of tasks only.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.wireloom.scratch", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="wireloom-")
        spark.conf.set("spark.wireloom.scratch", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a scanned table for each file of what a pass over it returns; a writer holds about so many.
FILE_BYTES = 32 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows in what is planned meanwhile.

    A batch of long texts lies in memory several times, on both sides of a
    Python worker.
    """
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, whose worker gives what it freed back to the system at the end of a task: workers live on between stages."""

    @wraps(run)
    def to_the_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return to_the_end


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """df, computed once, on the executors' disks; what is lost with one is computed again.

    For passes over a table, which give the same rows again. The session's
    cache has it until spark.catalog.clearCache().
    """
    with small_batches(df.sparkSession):
        return df.persist(StorageLevel.DISK_ONLY)


def few_files(df: DataFrame, scan: DataFrame) -> DataFrame:
    """df, a pass over scan, in partitions of FILE_BYTES of it, but no fewer than there are cores."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    return df.coalesce(min(n, 1 << 30))  # unknown sizes are huge


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_dir named."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def struct_of(**fields: T.DataType | str) -> T.StructType:
    """A struct type; strings name atomic types, and "[x]" an array of x."""
    atomic = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}

    def kind(x: T.DataType | str) -> T.DataType:
        if isinstance(x, str):
            return T.ArrayType(kind(x[1:-1])) if x[0] == "[" else atomic[x]
        return x

    return T.StructType([T.StructField(name, kind(x)) for name, x in fields.items()])


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Rows up to which a table of keys is broadcast (some 20 MB); beyond, the join is shuffled.
BROADCAST_KEYS = 500_000


def hinted(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it is counted to be small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def join_hot(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined to few, a row for each key, where one key may be that of a third of all rows.

    few is written, counted and broadcast up to BROADCAST_KEYS rows, so that rows
    aren't dealt by key. Beyond, both are shuffled, and adaptive execution splits
    the hot partitions of rows.
    """
    return rows.join(hinted(keep(few, "few")), on, how)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in gone (a table, one column), in a join fit for its size."""
    return rows.join(hinted(gone), key, "left_anti")
