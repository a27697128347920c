"""Streams over event files: counts per window, replay detection and ingest of landed files.

Each reads what has landed (``availableNow``), keeps its state in checkpoints in the shared folder, and
can be stopped and resumed. Test timestamps have no zone, so they are read as UTC.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators.provenance import HORIZON_HOURS, NONCE
from trustloom.sources.storage import delete, shared_folder


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the schema is that of what has landed."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, so that the table may be one file or a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path + "*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Events and mean value per window and type.

    A live stream closes a window ``late`` after its end, gives it out (append mode) and forgets it. Over all that has landed, in any
    order, None keeps every window (complete mode): the state is a row per window and type.
    """
    windows = (events if late is None else events.withWatermark("ts", late)).groupBy(F.window("ts", width), "event_type")
    counts = windows.agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "mean_value")


def first_uses(events: DataFrame, late: str | None = f"{HORIZON_HOURS} hours") -> DataFrame:
    """The first event of each nonce; what is dropped is a replay.

    A live stream forgets nonces after ``late`` and drops what comes later than that. Over a whole table
    that is wrong in any order of its files: None keeps every nonce and drops nothing.
    """
    if late is None:
        return events.dropDuplicates(list(NONCE))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(NONCE))


def run_to_table(stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Run over what has landed and give the result as a batch table.

    Complete results replace the table in each micro-batch; appended ones go to a file sink
    whose log makes them exactly-once.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start()
    else:
        query = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    delete(spark, f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
