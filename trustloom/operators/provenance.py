"""Inference provenance and integrity over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.columns import risk_level, short_digest
from trustloom.sources.storage import materialise

#: The columns that make up a nonce.
NONCE = ("user_id", "event_type", "props")
#: A nonce that is used again within so many hours is a replay.
HORIZON_HOURS = 24


def provenance(events: DataFrame) -> DataFrame:
    """Digests of input, configuration and record of each inference, and their display form."""
    hashed = events.select(
        "event_id",
        F.sha2(F.col("props"), 256).alias("input_sha256"),
        F.sha2(F.col("event_type"), 256).alias("config_sha256"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in NONCE]).alias("nonce"),
    )
    return hashed.withColumn("input_shown", short_digest(F.col("input_sha256")))


def replays(events: DataFrame, hours: int = HORIZON_HOURS) -> DataFrame:
    """Events whose nonce occurred within ``hours`` before, with the time since then in seconds.

    The events of a nonce are dealt by minute, so that a flood of one is not one task's; the last event of each
    minute is carried over to the first of the next minute that has any.
    """
    rows = events.select("event_id", "user_id", "ts", F.struct(*NONCE).alias("nonce"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"))
    lasts = rows.groupBy("nonce", "minute").agg(F.max("ts").alias("last"))
    carried = lasts.select("nonce", "minute", F.lag("last").over(Window.partitionBy("nonce").orderBy("minute")).alias("carried"))
    inside = F.lag("ts").over(Window.partitionBy("nonce", "minute").orderBy("ts", "event_id"))
    seen = rows.withColumn("inside", inside).join(carried, ["nonce", "minute"])
    seen = seen.withColumn("previous_ts", F.coalesce("inside", "carried")).filter(F.col("previous_ts").isNotNull())
    apart = F.expr("timestampdiff(SECOND, previous_ts, ts)")
    return seen.select("event_id", "user_id", apart.alias("seconds")).filter(F.col("seconds") < hours * 3600)


def tampered(events: DataFrame, recorded: DataFrame) -> DataFrame:
    """Events whose recomputed digest differs from the recorded one (``event_id``, ``digest``), or that have none."""
    now = events.select("event_id", F.sha2(F.col("props"), 256).alias("computed"))
    both = now.join(recorded.select("event_id", F.col("digest").alias("recorded")), "event_id", "left")
    return both.filter(~F.col("computed").eqNullSafe(F.col("recorded")))


def integrity(events: DataFrame, hours: int = HORIZON_HOURS) -> DataFrame:
    """Per event type: events, replays and the risk level of the rate."""
    bad = replays(events, hours).select("event_id", F.lit(1).alias("bad"))
    joined = events.select("event_id", "event_type").join(bad, "event_id", "left")
    out = joined.groupBy("event_type").agg(F.count("*").alias("events"), F.count("bad").alias("replays"))
    rate = F.round(F.col("replays") / F.col("events"), 6)
    return out.withColumn("rate", rate).withColumn("level", risk_level(rate, 0.002, 0.01, 0.05))


def _detected(flag: str, yes: str, no: str) -> Column:
    return F.when(F.col(flag).isNotNull(), yes).otherwise(no)


def checked(events: DataFrame, recorded: DataFrame, model: DataFrame, hours: int = HORIZON_HOURS) -> DataFrame:
    """Every event's provenance with ``model_sha256`` (of the one row ``model``), ``replayed`` and ``altered`` (1 or null) and the ``level`` of its type:
    the risk by the share of its events that are replays or were altered."""
    bad = replays(events, hours).select("event_id", F.lit(1).alias("replayed"), F.lit(None).cast("int").alias("altered"))
    changed = tampered(events, recorded).select("event_id", F.lit(None).cast("int").alias("replayed"), F.lit(1).alias("altered"))
    marks = bad.unionByName(changed).groupBy("event_id").agg(F.max("replayed").alias("replayed"), F.max("altered").alias("altered"))
    marks = materialise(marks, "checked-marks")
    hit = events.select("event_id", "event_type").join(marks, "event_id", "left")
    rate = F.round(F.avg((F.col("replayed").isNotNull() | F.col("altered").isNotNull()).cast("double")), 6)
    levels = hit.groupBy("event_type").agg(risk_level(rate, 0.002, 0.01, 0.05).alias("level"))
    known = provenance(events).join(events.select("event_id", "event_type", "ts", "value"), "event_id").join(F.broadcast(model))  # one row
    return known.join(marks, "event_id", "left").join(levels, "event_type", "left")


def provenance_rows(events: DataFrame) -> DataFrame:
    """event_id, pos, label, value and copyable of each row of :func:`checked`: digests and the nonce can be copied, the state of a check is shown."""
    item = lambda pos, label, value, copyable: F.struct(
        F.lit(pos).alias("pos"), F.lit(label).alias("label"), value.alias("value"), F.lit(copyable).alias("copyable")
    )
    rows = F.array(
        item(0, "Input SHA256", F.col("input_shown"), True),
        item(1, "Model Digest", short_digest(F.col("model_sha256")), True),
        item(2, "Config Hash", short_digest(F.col("config_sha256")), True),
        item(3, "Nonce ID", F.col("nonce"), True),
        item(4, "Replay Check", _detected("replayed", "Failed", "Passed"), False),
    )
    return events.select("event_id", F.inline(rows))


def integrity_rows(events: DataFrame) -> DataFrame:
    """event_id, pos, label and value of the checks of each row of :func:`checked`."""
    item = lambda pos, label, value: F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("label"), value.alias("value"))
    rows = F.array(
        item(0, "Image Tampering", _detected("altered", "Failed", "Passed")),
        item(1, "Manipulation Risk", F.initcap("level")),
        item(2, "Replay Attack", _detected("replayed", "Detected", "Not Detected")),
    )
    return events.select("event_id", F.inline(rows))
