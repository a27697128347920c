"""The audit ledger: entries, hash chain, quarantine and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.columns import audit_tone, lookup, shown_timestamp

# What an event type is called in the ledger; ours.
ACTIONS = {"purchase": "Trusted", "signup": "Verified", "view": "Completed", "error": "Actioned"}


def audit_ledger(events: DataFrame) -> DataFrame:
    """The entries, newest first; ``time_key`` sorts as the time does."""
    return entries(events).orderBy(F.desc("time_key"), F.desc("event_id"))


def entries(events: DataFrame) -> DataFrame:
    """The entries in no order."""
    status = lookup(ACTIONS, F.col("event_type"), "Recorded")
    return events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_key"),
        shown_timestamp(F.col("ts")).alias("timestamp"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("target"),
        status.alias("status"),
    ).withColumn("tone", audit_tone(F.col("status")))


def audit_chain(events: DataFrame, block: int = 1000) -> DataFrame:
    """A hash chain per day and actor, in blocks of ``block`` event ids: the head of a block is
    sha256(... sha256(sha256(e1) e2) ...), and the heads of the blocks are chained in the same way.

    So a row never holds more than a block, or the heads of an actor's blocks of one day.
    """

    def chained(items: Column, field: str) -> Column:
        return F.aggregate(items, F.lit(""), lambda acc, e: F.sha2(F.concat(acc, e[field]), 256))

    entry = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit("")))
    place = F.floor(F.col("event_id") / block).alias("place")
    rows = events.select(F.to_date("ts").alias("day"), "user_id", place, F.struct("event_id", entry.alias("entry")).alias("e"))
    blocks = rows.groupBy("day", "user_id", "place").agg(F.sort_array(F.collect_list("e")).alias("es"), F.count("*").alias("n"))
    blocks = blocks.select("day", "user_id", "n", F.struct("place", chained(F.col("es"), "entry").alias("head")).alias("b"))
    days = blocks.groupBy("day", "user_id").agg(F.sort_array(F.collect_list("b")).alias("bs"), F.sum("n").alias("entries"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "entries", chained(F.col("bs"), "head").alias("head"))


def without_quarantined(docs: DataFrame, quarantine: DataFrame) -> DataFrame:
    return docs.join(quarantine.select("doc_id").distinct(), "doc_id", "left_anti")


def search(assessments: DataFrame, text: str) -> DataFrame:
    return assessments.filter(F.contains(F.lower("name"), F.lit(text.lower())))
