"""The corpus pipeline: five training-data operators, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next one's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.common import free_names, given, materialise, put_back, release, set_aside, table, text_of, word_count
from trustloom.llm.cotrain import score_quality
from trustloom.llm.mixing import cycled_weights, mix
from trustloom.llm.queries import packed_documents
from trustloom.llm.simhash import near_duplicates
from trustloom.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Defined results: each row is scored by itself, so repeated rows, equal ids and null ids stay or go by their own text and
    metadata; null text is the empty text; null language, source and length are values like others; without labels of both
    kinds everything stays; an empty table gives no row; extra columns of any name come back unchanged.
    """
    own = ("doc_id", "text", "lang", "source", "n_chars")
    scored = score_quality(set_aside(docs, *own), table(spark, sf_dir, "labels"))
    return put_back(scored.filter("keep"), docs.columns, *own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays.

    Defined results: a document is what has one doc_id and one text. Of rows that repeat both, one stays; rows of one
    doc_id with other texts are documents of their own, and of those in one group one stays; a null doc_id comes after every other; null
    text is the empty text, and texts without words are alike; an empty table gives no row; extra columns of any name
    come back unchanged (of repeated rows that differ in them, those of any one row).
    """
    key, times = free_names(docs.columns, "key", "times")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", text_of()))
    groups = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).distinct()
    groups = materialise(groups.filter("doc_id is not null").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")), "pipeline-groups")
    ids = keyed.groupBy(F.col(key).alias("key")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    ids = materialise(ids, "pipeline-ids")
    # only groups of several documents lose any
    several = groups.groupBy("group").agg(F.count("*").alias("documents")).filter("documents > 1").select("group")
    members = groups.join(several, "group").join(ids, "key").select("key", "group", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("rank"))
    members = materialise(members, "pipeline-members")
    first = members.groupBy("group").agg(F.min("rank").alias("first"))
    gone = members.join(first, "group").filter("rank != first").select(F.col("key").alias(key))
    again = ids.filter("n > 1").select(F.col("key").alias(key))
    gone, again = materialise(gone, "pipeline-gone"), materialise(again, "pipeline-again")
    once = keyed.join(gone.unionAll(again), key, "left_anti")
    repeated = keyed.join(again, key, "left_semi").join(gone, key, "left_anti").dropDuplicates([key])
    return once.unionAll(repeated).drop(key)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that start in an earlier document go; so does a document that loses all its words.

    Defined results: a text that loses words has its other words joined by one blank and ``n_chars`` of the new text;
    any other row comes back as it was, so null and empty texts, short texts and rows of null doc_id stay; rows of equal doc_id
    cause each other no loss; an empty table gives no row; extra columns of any name come back unchanged.
    """
    own = ("doc_id", "text", "n_chars")
    cut = remove_repeats(set_aside(docs, *own), k=50).filter("n_removed = 0 or n_removed < n_words")
    lost = F.col("n_removed") > 0
    kept = F.col("kept_text")
    changed = {"text": F.when(lost, kept).otherwise(F.col("text")), "n_chars": F.when(lost, F.length(kept).cast("bigint")).otherwise(F.col("n_chars"))}
    return put_back(cut.withColumns(changed), docs.columns, *own)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Defined results: null text and texts without words have size 0 and go, as a mix of words can't take them; a null
    source is a source, last in order; rows of equal doc_id, source and text share a hash and are taken together; an empty
    table gives no row; extra columns of any name come back unchanged.
    """
    own = ("doc_id", "source", "text")
    sized = set_aside(docs, *own).withColumns({"size": word_count(text_of()), "hash": F.xxhash64("doc_id", "source", text_of())})
    mixed = mix(sized, cycled_weights(docs)).filter("times > 0")
    return put_back(mixed.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))), docs.columns, *own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens.

    Defined results: null text is the empty text, one piece of the end id alone; rows of equal doc_id are documents of their
    own; a null doc_id is carried along; an empty table gives no row; other columns are ignored.
    """
    return packed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Training, SimHash and tokenizing can't be said in SQL. Tests hold substring_dedup and packing against brute force, near_dedup against
#: all pairs of a fixture, and quality against labels that it has not seen.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. Each stage's intermediate tables go when what it keeps is written, and so does its input."""
    docs, before = table(spark, sf_dir, "documents"), given()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
