"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, with its store. Where that is unset, in local mode (tests, a laptop), the warehouse; on a cluster a
    warehouse on the machine's own disk is refused, as other machines don't see it."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    path, store = _hadoop(spark, given or spark.conf.get("spark.sql.warehouse.dir"))
    found = store.makeQualified(path).toString().rstrip("/")
    if not given and found.startswith("file:") and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def delete(spark: SparkSession, folder: str) -> None:
    path, store = _hadoop(spark, folder)
    store.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path, store = _hadoop(spark, folder)
    return store.exists(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: later steps start from it, a lost executor costs no more than its own tasks,
    and the optimizer knows its size."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
