"""Session settings that the library relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    That is `spark.checkpoint.dir`, or else the context's checkpoint folder.
    Where neither is set, a temporary folder is made and set, but only if the
    master is local: executors of a cluster don't share one machine's folders,
    so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None)
    known = context._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        # The context adds a folder of its own below the one it was given.
        folder = known.get()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set(_SETTING, folder)
    if known.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies; none there is fine."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows live in the shared folder, so lost executors don't matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a compressed table by columns, of which later readers read what they need.

    A checkpoint holds whole rows uncompressed.  The table is deleted when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove_at_end, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended before
        pass


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, over all cores where it comes in fewer pieces than there are cores.

    A file of one row group is read by one task, and so would be all that follows.
    Tables in as many pieces as there are cores, as large ones are, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df
