"""Shared helpers: tables, scratch tables in the shared folder, text-to-words rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What separates words everywhere in this subpackage: space and \t \n \v \f \r. `bytes.split()` uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where that is unset, a session of one process has one of
    its own; on a cluster that is an error, since a folder of the driver's machine is none of the executors'."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir()
        if found.isDefined():
            base = found.get()
        else:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="rivulet-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer, whatever store it is in."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; whatever is left there goes when the driver ends in the usual way."""
    root = f"{shared_dir(spark)}/rivulet-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def _forget(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now, or the folder
        if spark.sparkContext._jsc is not None:
            delete(spark, root)


def release() -> None:
    """Gives free memory of a Python worker back, as its task ends: the process lives on beside the next stages'."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of an Arrow batch between Spark and its Python workers, in which whole texts go.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: 10,000 rows of texts may be more than a worker holds. A setting that is there stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: ends its lineage, survives lost executors, runs once."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._rivulet_path = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes what `cut` wrote, once nothing that is still to run reads it."""
    delete(df.sparkSession, df._rivulet_path)
