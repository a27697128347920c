"""Uploads of documents with an updated quality report, without a rescan of what came before.

Each micro-batch is an upload, keyed by its batch id. Its rows are validated, and what fails goes to a dead-letter table with the reason. Of the others
only partial results are kept: the digests of the texts, and sums. The totals after an upload are those before it and its own partial sums; which of
its texts were there before is found by joining its digests with the kept ones. Every write replaces the batch's own folder, so a replayed
batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators.quality import containing, corrupted, dataset_quality_rows
from trustloom.sources.storage import exists

_SUMS = ("total", "duplicate", "corrupted", "unlabelled", "suspicious")
_TOTALS = ", ".join(f"{c} bigint" for c in _SUMS)


def problem(docs: DataFrame) -> DataFrame:
    """``docs`` with ``reason``: why a row can't be taken, or null."""
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.col("text").isNull(), "no text").when(F.col("source").isNull(), "no contributor")
    return docs.withColumn("reason", reason)


class Uploads:
    """The tables of one dataset in ``folder``: ``dead``, ``digests`` and ``totals``, each with a folder for every batch."""

    def __init__(self, spark: SparkSession, folder: str, labels: DataFrame, items: DataFrame):
        self.spark, self.folder, self.labels, self.items = spark, folder, labels, items

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.folder}/{name}/batch={batch_id}"

    def _before(self, name: str, batch_id: int, schema: str) -> DataFrame:
        """What the batches before ``batch_id`` have left; a later one that is replayed does not see itself."""
        if not exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/{name}").filter(F.col("batch") < batch_id)

    def take(self, upload: DataFrame, batch_id: int) -> None:
        """Take one upload; for ``foreachBatch``."""
        rows = problem(upload)
        rows.filter("reason is not null").write.mode("overwrite").parquet(self._path("dead", batch_id))
        good = rows.filter("reason is null")
        flags = good.select("doc_id", F.sha2("text", 256).alias("digest"), corrupted(F.col("text")).alias("corrupted"))
        marked = self.labels.select("doc_id", F.lit(True).alias("labelled")).distinct()
        hit = containing(good, self.items).select("doc_id", F.lit(True).alias("suspicious")).distinct()
        flags = flags.join(marked, "doc_id", "left").join(hit, "doc_id", "left")
        flag = lambda c: F.sum(c.cast("bigint")).alias
        digests = flags.groupBy("digest").agg(
            F.count("*").alias("n"), flag(F.col("corrupted"))("corrupted"), flag(F.col("labelled").isNull())("unlabelled"), flag(F.col("suspicious").isNotNull())("suspicious")
        )
        digests.write.mode("overwrite").parquet(self._path("digests", batch_id))
        own = self.spark.read.parquet(self._path("digests", batch_id))
        known = self._before("digests", batch_id, "digest string").select("digest", F.lit(1).alias("known")).distinct()
        # of a text's rows one is no duplicate, if no upload before brought it
        delta = own.join(known, "digest", "left").agg(
            F.sum("n").alias("total"), F.sum(F.col("n") - F.when(F.col("known").isNull(), 1).otherwise(0)).alias("duplicate"), *[F.sum(c).alias(c) for c in _SUMS[2:]]
        )
        last = self._before("totals", batch_id, _TOTALS).orderBy(F.desc("batch")).limit(1).select(*_SUMS)
        both = last.unionByName(delta).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS])
        both.coalesce(1).write.mode("overwrite").parquet(self._path("totals", batch_id))

    def totals(self) -> DataFrame:
        """One row: the sums after the newest upload."""
        return self._before("totals", 1 << 62, _TOTALS).orderBy(F.desc("batch")).limit(1).select(*_SUMS)

    def report(self) -> DataFrame:
        """label, count and percent, as the batch query gives them of all rows that were taken."""
        return dataset_quality_rows(self.totals())

    def dead(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/dead")

    def run(self, stream: DataFrame, state: str) -> None:
        """Take what has landed since the last run."""
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(self.take).start().awaitTermination()
