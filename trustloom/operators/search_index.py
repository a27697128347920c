"""Full-text search: an inverted index in buckets of terms, and BM25 ranks.

The index holds a row for each term of each entry and lies in folders by a hash of the term, so a question reads the buckets of its own terms
and no others. Lengths of entries travel with the postings; counts of the whole are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.sources.storage import materialise

BUCKETS = 64
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(entries: DataFrame, path: str) -> None:
    """``entries``: ``kind``, ``name`` and ``text``. Entries without terms count in no statistic."""
    held = entries.select("kind", "name", terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0).withColumn("length", F.size("terms"))
    held = materialise(held, "index-entries")  # once: what the entries are made from can be large
    postings = held.select("kind", "name", "length", F.explode("terms").alias("term")).groupBy("term", "kind", "name", "length").agg(F.count("*").alias("tf"))
    postings = postings.withColumn("bucket", bucket(F.col("term")))
    postings.repartition("bucket", F.xxhash64("kind", "name") % 8).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    held.agg(F.count("*").alias("entries"), F.avg("length").alias("mean")).coalesce(1).write.parquet(f"{path}/statistics")


def search(spark: SparkSession, path: str, text: str, k: int = 10) -> DataFrame:
    """``place``, ``kind``, ``name`` and ``score`` of the ``k`` best entries that hold any term of ``text``; equal scores by kind and name."""
    asked = spark.createDataFrame([(text,)], "text string").select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"), F.col("text")).select("term", bucket(F.col("term")).alias("bucket"))
    wanted = asked.collect()  # the words of one question
    if not wanted:
        return spark.createDataFrame([], "place int, kind string, name string, score double")
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(sorted({r["bucket"] for r in wanted})) & F.col("term").isin([r["term"] for r in wanted]))
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))  # a row for each asked term
    rows = postings.join(F.broadcast(counts), "term").join(F.broadcast(spark.read.parquet(f"{path}/statistics")))  # one row
    rarity = F.log(1 + (F.col("entries") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = rarity * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    ranked = rows.groupBy("kind", "name").agg(F.round(F.sum(score), 6).alias("score"))
    best = ranked.orderBy(F.desc("score"), "kind", "name").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "kind", "name")).alias("place"), "kind", "name", "score")  # k rows
