"""Dataset quality: counts, duplicates, corrupted, unlabelled and suspicious samples, contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.columns import percent, risk_level, risk_tone
from trustloom.sources.storage import materialise

#: Characters of a short item that are looked for as one.
GRAM = 8
#: A text of which less than this share are letters counts as corrupted.
LETTER_SHARE = 0.6


def corrupted(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce(F.try_divide(letters * 1.0, F.length(text)) < LETTER_SHARE, F.lit(True))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id of the documents whose text contains an item's text.

    A document that contains an item has all its inner words, so the item's inner word of fewest documents is an equi-join
    key. Items of fewer than three words have no inner word; their first characters (``GRAM`` at most) are the key, and the
    texts' runs of that many characters are made only for the lengths that such items have. Candidates are verified.
    An empty item is contained nowhere, a null text contains nothing.
    """
    words = F.split(F.col("text"), r"\s+")
    items = items.filter(F.length("text") > 0).select("item_id", F.col("text").alias("item"))
    cut = F.split(F.col("item"), r"\s+")
    inner = F.slice(cut, F.lit(2), F.greatest(F.lit(0), F.size(cut) - 2))
    inner = F.filter(inner, lambda w: w != "")
    choices = items.select("item_id", F.explode(F.array_distinct(inner)).alias("word"))
    held = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(choices.select("word").distinct(), "word", "left_semi")
    held = materialise(held, "containing-held")  # once: texts are split for the counts and for the pairs
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    anchors = choices.join(counts, "word").groupBy("item_id").agg(F.min(F.struct("n", "word")).alias("x")).select("item_id", "x.word")
    pairs = held.join(anchors, "word").select("doc_id", "item_id")

    short = items.filter(F.size(inner) == 0).withColumn("key", F.left("item", F.lit(GRAM)))
    for n in sorted(r["n"] for r in short.select(F.length("key").alias("n")).distinct().collect()):  # GRAM rows at most
        runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        grams = docs.select("doc_id", F.explode(runs).alias("key"))
        pairs = pairs.unionAll(grams.join(short.filter(F.length("key") == n).select("key", "item_id"), "key").select("doc_id", "item_id"))
    found = pairs.join(docs.select("doc_id", "text"), "doc_id").join(items, "item_id")
    return found.filter(F.contains("text", "item")).select("doc_id", "item_id").distinct()


def duplicates(docs: DataFrame) -> DataFrame:
    """Every document's ``doc_id`` and whether it is a ``duplicate``, as in :func:`flagged`."""
    narrow = docs.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("none")).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return narrow.join(first, "digest", "left").select("doc_id", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


def flagged(docs: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with its flags: duplicate (not the smallest id of its text; null texts are equal), corrupted, unlabelled, suspicious."""
    narrow = docs.select("doc_id", "source", "lang", F.coalesce(F.sha2("text", 256), F.lit("none")).alias("digest"), corrupted(F.col("text")).alias("corrupted"))
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marked = labels.select("doc_id", F.lit(True).alias("labelled")).distinct()
    hit = containing(docs, items).select("doc_id", F.lit(True).alias("suspicious")).distinct()
    return (
        narrow.join(first, "digest", "left")
        .join(marked, "doc_id", "left")
        .join(hit, "doc_id", "left")
        .select(
            "doc_id",
            "source",
            "lang",
            (F.col("doc_id") != F.col("first_id")).alias("duplicate"),
            "corrupted",
            F.col("labelled").isNull().alias("unlabelled"),
            F.coalesce("suspicious", F.lit(False)).alias("suspicious"),
        )
    )


def _count(flag: str) -> Column:
    return F.sum(F.col(flag).cast("bigint"))


def dataset_quality(flags: DataFrame) -> DataFrame:
    """label, count, percent: one row for each kind of defect."""
    sums = flags.agg(
        F.count("*").alias("total"),
        *[F.coalesce(_count(f), F.lit(0)).alias(f) for f in ("duplicate", "corrupted", "unlabelled", "suspicious")],
    )
    return dataset_quality_rows(sums)


def dataset_quality_rows(sums: DataFrame) -> DataFrame:
    """The same from one row of sums: total, duplicate, corrupted, unlabelled, suspicious."""
    labels = (("Duplicates", "duplicate"), ("Corrupted", "corrupted"), ("Missing Labels", "unlabelled"), ("Suspicious", "suspicious"))
    stacked = ", ".join(f"'{label}', {flag}" for label, flag in labels)
    rows = sums.selectExpr("total", f"stack({len(labels)}, {stacked}) AS (label, count)")
    return rows.select("label", F.col("count").cast("bigint").alias("count"), percent(F.col("count"), F.col("total")).alias("percent"))


def dataset_overview(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("samples"),
        F.countDistinct("lang").alias("domains"),
        F.countDistinct("source").alias("contributors"),
        F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("domain_list"),
    )


def group_risk(flags: DataFrame, key: str, medium: float = 0.12, high: float = 0.2, critical: float = 0.4) -> DataFrame:
    """Defect rate and risk level of each group; a sample counts once, missing labels do not count."""
    bad = F.col("duplicate") | F.col("corrupted") | F.col("suspicious")
    rate = F.round(F.avg(bad.cast("double")), 6)
    out = flags.groupBy(key).agg(F.count("*").alias("samples"), F.sum(bad.cast("bigint")).alias("defects"), rate.alias("rate"))
    level = risk_level(F.col("rate"), medium, high, critical)
    return out.withColumn("level", level).withColumn("tone", risk_tone(F.col("level")))


def quality_rollup(flags: DataFrame) -> DataFrame:
    """Samples and defects by source and language with subtotals."""
    return flags.rollup("source", "lang").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count("*").alias("samples"),
        _count("duplicate").alias("duplicates"),
        _count("corrupted").alias("corrupted"),
    )
