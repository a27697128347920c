"""Quarantine over time: who was quarantined from when to when, and views as of an instant.

An actor's actions are dealt by day, and the last of each day is carried over to the next day that has any, so an actor
with any share of the events is no one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What puts an actor into quarantine and what ends it; ours.
ENTERS, LEAVES = "error", "purchase"


def _neighbour(rows: DataFrame, actor: str, value: Column, newest: bool) -> DataFrame:
    """``rows`` with ``other``: the ``value`` of the actor's row before (``newest``) or after each, by (ts, event_id)."""
    order = Window.partitionBy(actor, "day").orderBy("ts", "event_id")
    rows = rows.withColumn("own", value)
    inside = (F.lag if newest else F.lead)("own").over(order)
    pick = F.max_by if newest else F.min_by
    ends = rows.groupBy(actor, "day").agg(pick("own", F.struct("ts", "event_id")).alias("end"))
    days = Window.partitionBy(actor).orderBy("day")
    carried = ends.select(actor, "day", (F.lag if newest else F.lead)("end").over(days).alias("carried"))
    return rows.withColumn("inside", inside).join(carried, [actor, "day"]).withColumn("other", F.coalesce("inside", "carried")).drop("own", "inside", "carried")


def quarantines(events: DataFrame, actor: str = "user_id") -> DataFrame:
    """``actor``, ``since`` and ``until`` (null: to this day) of every quarantine; entering or leaving twice in a row counts once."""
    acts = events.filter(F.col("event_type").isin(ENTERS, LEAVES) & F.col(actor).isNotNull() & F.col("ts").isNotNull())
    acts = acts.select(actor, "event_id", "ts", F.to_date("ts").alias("day"), (F.col("event_type") == ENTERS).alias("enters"))
    before = _neighbour(acts, actor, F.col("enters"), newest=True)
    changes = before.filter(F.col("enters") != F.coalesce("other", F.lit(False))).drop("other")
    ends = _neighbour(changes, actor, F.col("ts"), newest=False)
    return ends.filter("enters").select(actor, F.col("ts").alias("since"), F.col("other").alias("until"))


def record(intervals: DataFrame, path: str) -> None:
    """Write the quarantines by the month they began in; what is written again replaces its months, so a repeated run changes nothing."""
    months = intervals.withColumn("month", F.date_format("since", "yyyy-MM"))
    months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def free_at(rows: DataFrame, intervals: DataFrame, instants: list[str], actor: str = "user_id") -> DataFrame:
    """``instant`` and the ``rows`` whose actor was not quarantined then. ``instants`` is a short list."""
    times = F.explode(F.array(*[F.lit(x).cast("timestamp_ntz") for x in instants])).alias("instant")
    held = intervals.select(actor, "since", "until", times).filter((F.col("since") <= F.col("instant")) & (F.col("until").isNull() | (F.col("until") > F.col("instant"))))
    return rows.select(times, *rows.columns).join(held.select("instant", actor).distinct(), ["instant", actor], "left_anti")
