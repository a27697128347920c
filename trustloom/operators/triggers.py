"""Backdoor triggers of one to three words: frequent n-grams that go with a class.

Frequent means: in at least ``support`` samples of the class. Those are found in the samples of the class alone, and only they are counted in all
samples. A sample's runs are made in its own row, so no places of words are shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.sources.storage import materialise


def _runs(texts: DataFrame, n: int) -> DataFrame:
    """``toxic`` and ``gram`` of the distinct runs of ``n`` words of each sample; a sample counts once, whatever it repeats."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1))), lambda i: i <= F.size("words") - (n - 1))
    return texts.select("toxic", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(n)), " ")))).alias("gram"))


def _counted(texts: DataFrame, n: int, support: int) -> DataFrame:
    """The frequent runs with the numbers of all samples and of those of the class that hold them."""
    frequent = _runs(texts.filter("toxic != 0"), n).groupBy("gram").agg(F.sum("toxic").cast("bigint").alias("toxic_samples"))
    frequent = materialise(frequent.filter(F.col("toxic_samples") >= support), "trigger-frequent")
    held = _runs(texts, n).join(frequent.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("samples"))
    return materialise(held.join(frequent, "gram").select("gram", "samples", "toxic_samples"), "trigger-counts")


def trigger_phrases(docs: DataFrame, labels: DataFrame, longest: int = 3, support: int = 5, lift: float = 3.0) -> DataFrame:
    """``n``, ``gram``, ``samples``, ``toxic_samples``, ``lift`` (P(toxic | run) / P(toxic)) and ``score``, the log-likelihood ratio of the run
    and the class; those of at least this lift.

    Null texts have no words; of several labels of a sample the greatest counts; a sample is a doc_id, of repeated ones the first text in order.
    """
    marked = labels.groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    texts = docs.select("doc_id", "text").join(marked.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = materialise(texts.join(marked, "doc_id").select("toxic", words.alias("words")), "trigger-texts")
    base = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    found = None
    for n in range(1, longest + 1):
        level = _counted(texts, n, support).withColumn("n", F.lit(n))
        found = level if found is None else found.unionByName(level)
    scored = found.withColumnRenamed("samples", "s").withColumnRenamed("toxic_samples", "t").join(F.broadcast(base.select(F.col("n").alias("all"), "k")))  # one row
    s, t, all_, k = (F.col(c).cast("double") for c in ("s", "t", "all", "k"))
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    score = 2 * (part(t, s * k / all_) + part(s - t, s * (all_ - k) / all_) + part(k - t, (all_ - s) * k / all_) + part(all_ - s - k + t, (all_ - s) * (all_ - k) / all_))
    out = scored.select("n", "gram", F.col("s").alias("samples"), F.col("t").alias("toxic_samples"), F.round((t / s) / (k / all_), 4).alias("lift"), F.round(score, 4).alias("score"))
    return out.filter(F.col("lift") >= lift)
