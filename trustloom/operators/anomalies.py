"""Detectors over labelled vectors and texts, and the samples that show what they found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.columns import risk_level, risk_tone


def _components(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))


def centroids(vectors: DataFrame) -> DataFrame:
    """One mean vector per label, as a map-side average of components."""
    means = _components(vectors).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))


def model_digest(vectors: DataFrame) -> DataFrame:
    """One row, ``model_sha256``: the digest of the nearest-centroid model, by label its components to six decimals."""
    parts = F.array_join(F.transform("c", lambda p: F.format_string("%.6f", p["x"])), ",")
    rows = centroids(vectors).filter("label is not null").select("label", F.concat(F.col("label").cast("string"), F.lit(":"), parts).alias("text"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("label", "text"))).alias("a"))  # a row per label
    return whole.select(F.sha2(F.array_join(F.transform("a", lambda x: x["text"]), ";"), 256).alias("model_sha256"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroid_scores(vectors: DataFrame, broadcast_labels: int = 4096) -> DataFrame:
    """vec_id, label, and the inner product with each label's centroid (``other``, ``score``).

    Up to ``broadcast_labels`` centroids are broadcast; more are joined in blocks of that many, to which the vectors are sent.
    """
    own = centroids(vectors).select(F.col("label").alias("other"), F.transform("c", lambda p: p["x"]).alias("c"))
    labels = vectors.select("label").distinct().count()
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    if labels <= broadcast_labels:
        pairs = rows.join(F.broadcast(own))
    else:
        blocks = -(-labels // broadcast_labels)
        own = own.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(blocks)).cast("int"))
        pairs = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(own, "block")
    return pairs.select("vec_id", "label", "other", F.round(_dot(F.col("v"), F.col("c")), 9).alias("score"))


def label_flips(vectors: DataFrame) -> DataFrame:
    """Vectors that lie nearest to another label's centroid."""
    best = centroid_scores(vectors).groupBy("vec_id", "label").agg(F.max(F.struct(F.col("score"), (-F.col("other")).alias("neg"))).alias("b"))
    return best.select("vec_id", "label", (-F.col("b.neg")).alias("nearest"), F.col("b.score").alias("score")).filter("label != nearest")


def out_of_distribution(vectors: DataFrame, quantile: float = 0.02) -> DataFrame:
    """Vectors whose inner product with their own centroid is among the lowest ``quantile`` of their label (at least one)."""
    own = centroid_scores(vectors).filter("label = other").select("vec_id", "label", "score")
    # ranks in two steps, so that no task sorts a label: rows per thousandth of the score, then ranks inside the lowest ones
    own = own.withColumn("step", F.floor(F.col("score") * 1000))
    steps = own.groupBy("label", "step").agg(F.count("*").alias("k"))
    below = Window.partitionBy("label").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(
        "label",
        "step",
        F.coalesce(F.sum("k").over(below), F.lit(0)).alias("before"),
        F.greatest(F.lit(1), F.floor(F.sum("k").over(Window.partitionBy("label")) * F.lit(quantile))).alias("n"),
    ).filter("before < n")
    inside = F.row_number().over(Window.partitionBy("label", "step").orderBy("score", "vec_id"))
    ranked = own.join(steps, ["label", "step"]).withColumn("place", (F.col("before") + inside).cast("bigint"))
    return ranked.filter("place <= n").select("vec_id", "label", "score", "place")


def trigger_words(docs: DataFrame, labels: DataFrame, lift: float = 3.0, support: int = 5) -> DataFrame:
    """Words that are over-represented among the toxic samples: support and lift above the limits.

    Our definition of a backdoor trigger: lift = P(toxic | word) / P(toxic).
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    marked = labels.select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = docs.join(marked, "doc_id").select("toxic", F.explode(words).alias("word")).filter("word != ''")
    base = marked.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg(F.col("toxic").cast("double")).alias("base"))
    by_word = rows.groupBy("word").agg(F.count("*").alias("samples"), F.sum("toxic").cast("bigint").alias("toxic_samples"))
    scored = by_word.filter(F.col("toxic_samples") >= support).join(F.broadcast(base))  # base is one row
    score = F.round(F.col("toxic_samples") / F.col("samples") / F.col("base"), 4)
    return scored.select("word", "samples", "toxic_samples", score.alias("lift")).filter(F.col("lift") >= lift)


def levels(rates: DataFrame) -> DataFrame:
    """name, rate -> with level and tone; the level is that of the rate shown."""
    rate = F.round("rate", 6)
    level = risk_level(rate, 0.02, 0.1, 0.5)
    return rates.select("name", rate.alias("rate"), level.alias("level")).withColumn("tone", risk_tone(F.col("level")))


def evidence(flags: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` flagged documents of smallest id for each rule."""
    rules = F.array(*[F.when(F.col(f), F.lit(f)) for f in ("duplicate", "corrupted", "suspicious")])
    rows = flags.select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy("doc_id")).cast("bigint")
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("rule", "place", "doc_id")


def evidence_chips(flips: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """The evidence cards: rule, place and the chips in order; the first ``k`` label flips and suspicious documents by id."""
    true = F.concat(F.lit("True: "), F.col("label").cast("string"))
    predicted = F.concat(F.lit("Pred: "), F.col("nearest").cast("string"))
    cards = flips.select(F.lit("label flip").alias("rule"), F.col("vec_id").alias("id"), F.array(true, predicted).alias("chip"))
    cards = cards.unionByName(hits.select(F.lit("suspicious").alias("rule"), F.col("doc_id").alias("id"), F.array(F.lit("Suspicious Pattern")).alias("chip")).distinct())
    place = F.row_number().over(Window.partitionBy("rule").orderBy("id")).cast("bigint")
    return cards.withColumn("place", place).filter(F.col("place") <= k).select("rule", "place", "id", "chip")
