"""Shared-folder tables, size-checked joins and Arrow plumbing for the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Right-hand rows up to which a join side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows that go to a Python worker at once while a table is written; Spark's 10,000 texts are much for both sides.
BATCH_ROWS = 1000
#: Bytes of a broadcast join side at most, whatever its row count.
BROADCAST_BYTES = 48 << 20

_own: dict[str, str] = {}
_held: dict[str, object] = {}


def held(owner: str, key=None, make=lambda: None):
    """What an operator keeps in a Python worker, made anew for another key. A worker that is used again holds the state
    of one operator at a time: what the one before kept goes when the next begins."""
    if _held.get("name") != (owner, key):
        _held.clear()
        gc.collect()
        _trim()
        _held["value"] = make()
        _held["name"] = (owner, key)
    _trim()
    return _held["value"]


def _trim() -> None:
    """Gives the memory that earlier tasks of this worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Lets the executors collect their garbage, after which a JVM gives back the heap that an earlier operator made it
    take; else it keeps that beside the Python workers of the next. As many tasks as cores, so that each executor gets one."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc')").collect()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or, where one machine is all there is (tests), a fresh one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="factweave-"))
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone at interpreter exit; leftovers are only scratch files
        pass


def materialize(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Writes df below the shared folder and reads it back: lineage ends there and survives lost executors. The
    files of its shuffles go when it is written. Python workers get so many rows at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes what materialize wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        if df is not None:
            _remove(df.sparkSession, df.scratch)


def join_sized(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int = 32) -> DataFrame:
    """Joins with right broadcast only if its counted rows prove small; otherwise by a shuffle.

    right should be a materialized table, so that counting it costs a footer read.
    """
    rows = right.count()
    if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
