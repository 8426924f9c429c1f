"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches are bounded in rows and in bytes, so that a run of very long texts stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_WRITTEN: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session; a temporary one only where that is unset in a local session, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strata-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/strata-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again, and let Spark clear the shuffle files of plans that are no longer held."""
    jvm = spark.sparkContext._jvm
    for path in {file.rpartition("/")[0] for table in tables for file in table.inputFiles()}:
        found = jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
    gc.collect()
    jvm.System.gc()


def drop_written(spark: SparkSession) -> None:
    """Delete every table this process has materialized; results read from them are then gone."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """Free memory goes back to the system: workers are reused, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has the call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    def run(batches):
        yield from function(batches)
        _give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; a null text has none. Words are maximal runs without space, tab, LF, VT, FF, CR."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
