"""Tables that are read many times: written once where all executors can read them, so a lost executor costs no recomputation."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='strata-')}"
        spark.sparkContext.setCheckpointDir(found)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Delete the files of a ``settled`` table that nothing will read again, and let Spark clear the shuffle files of plans that are no longer held."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    clear_spent(spark)


def clear_spent(spark: SparkSession) -> None:
    """Let Spark clear the shuffle files of plans that are no longer held."""
    for pause in (0.5, 0):  # the JVM learns a little later which plans Python has let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
